"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.llm import (
    bin_packing,
    chat_format,
    collocations,
    conversation_repair,
    exact_dedup,
    mixing,
    ngram_join,
    secret_scan,
    token_counts,
    token_files,
    topk_search,
    toxicity,
    warc,
)
from skysense.llm.encode import tokenizer_path

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
TOKEN_LIMIT = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.topk(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.categories(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bin_packing.pack(table(spark, folder, "documents"), tokenizer_path(WORDS))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, folder, "documents"), tokenizer_path(WORDS))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures(spark, table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, folder, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("__copy").cast("long").alias("copy"),
                        F.col("__order").alias("shuffle_key"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path(PIECES))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat_format.with_hostile(table(spark, folder, "conversations"))
    return chat_format.digest(chat_format.formatted(turns))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damaged(turns))
    return conversation_repair.digest(turns, repaired)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bin_packing": op5_bin_packing,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Tokenizers and fitted models (2, 5, 6, 9) and positions of all matches (10) aren't SQL.
ORACLES = {
    "op1_topk_search": topk_search.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_warc": warc.SQL,
    "op8_mixing": mixing.sql(),
    "op11_collocations": collocations.SQL,
    "op12_chat_format": chat_format.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
