"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysense.llm import bin_packing, exact_dedup, mixing, ngram_join, toxicity
from skysense.llm.common import stored
from skysense.llm.encode import tokenizer_path

#: Near duplicates: shingles of five words, similarity 0.8 or more.
NEAR = ngram_join.Similar(words=5, num=80, den=100)


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the chain of classifiers doesn't call toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs, how=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Copies of the documents so that sources reach their target weights."""
    return mixing.replicate(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return bin_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bin_packing", pack_sequences),
]

#: Packing needs a tokenizer and scoring a fitted model, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
