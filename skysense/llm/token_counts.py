"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

The vocabulary of ``piece_bpe_32k.model`` joins no space mark after other characters and
knows no piece with a line feed. So a text's length is the sum of the lengths of its
pre-tokens: what stands between single spaces, and within it what stands between line
feeds. Lengths of the most frequent pre-tokens lie in a broadcast table of bounded size;
others are encoded by the worker, which keeps them in a bounded cache.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import slices, stored

#: Pre-tokens in the broadcast table, and of how many characters at most.
TABLE_ROWS = 50_000
TABLE_CHARS = 32
#: Candidates for the table that a task hands on.
TASK_ROWS = 10_000
#: Lengths that a worker keeps; then it starts anew.
CACHE_ROWS = 100_000

_MARK = "▁"


def usual(texts: pa.Array) -> np.ndarray:
    """Which texts the cutting below holds for; others are encoded whole."""
    # A leading space forms a run with the mark that every text begins with.
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, _MARK)), pc.starts_with(texts, " "))
    return ~odd.to_numpy(zero_copy_only=False).astype(bool)


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each pre-token, its number among the different ones, and these.

    One that begins with a line feed stands without a space mark, all others with one.
    """
    lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
    rows = pc.list_parent_indices(lists).to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    return rows, coded.indices.to_numpy(), coded.dictionary


class PieceLengths:
    """Lengths of pre-tokens by the sentencepiece model at ``path``, with the frequent ones given."""

    def __init__(self, path: str, frequent: pa.Array, lengths: np.ndarray):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        if any("\n" in p or _MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError(f"{path} has pieces that join what is cut here")
        self.frequent, self.lengths = frequent, lengths
        self.known: dict[str, int] = {}

    def encode(self, tokens: list[str]) -> list[int]:
        # A text that begins with a line feed begins with the mark, which doesn't count here.
        made = self.model.encode(tokens, num_threads=1)
        return [1 if not t else len(ids) - (t[0] == "\n") for t, ids in zip(tokens, made)]

    def of(self, tokens: pa.Array) -> np.ndarray:
        out = np.empty(len(tokens), np.int64)
        at = pc.index_in(tokens, value_set=self.frequent)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        out[hit] = self.lengths[at.drop_null().to_numpy()]
        rest = tokens.filter(pa.array(~hit)).to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if len(known) > CACHE_ROWS:
            known.clear()
        missing = [t for t in rest if t not in known]
        for i in range(0, len(missing), 5_000):
            part = missing[i : i + 5_000]
            known.update(zip(part, self.encode(part)))
        out[~hit] = list(map(known.__getitem__, rest))
        for t in missing:
            if len(t) > 64:
                del known[t]
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each of ``texts`` (no nulls)."""
        out = np.zeros(len(texts), np.int64)
        cut = usual(texts)
        cut_texts = texts.filter(pa.array(cut))
        if len(cut_texts):
            rows, number, different = pretokens(cut_texts)
            each = self.of(different)[number]
            out[cut] = np.bincount(rows, weights=each, minlength=len(cut_texts)).astype(np.int64)
        for i in np.flatnonzero(~cut):
            out[i] = len(self.model.encode(texts[int(i)].as_py()))
        out[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        return out


_MODELS: dict[str, PieceLengths] = {}


def worker_model(path: str) -> PieceLengths:
    """The worker's model for ``path``, whose cache outlives a task."""
    if path not in _MODELS:
        _MODELS[path] = PieceLengths(path, pa.array([], pa.large_string()), np.zeros(0, np.int64))
    return _MODELS[path]


def frequent_pretokens(docs: DataFrame, text: str, rows: int = TABLE_ROWS) -> DataFrame:
    """The most frequent pre-tokens of all texts, as nearly as bounded lists per task tell.

    A task counts all its pre-tokens in a bounded table that drops the rarest when full and
    hands on its ``TASK_ROWS`` most frequent ones. What is missed only costs time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            texts = pc.fill_null(b.column(0).cast(pa.large_string()), "")
            for start, stop in slices(texts):
                part = texts[start:stop]
                part = part.filter(pa.array(usual(part)))
                if not len(part):
                    continue
                _, number, different = pretokens(part)
                times = np.bincount(number, minlength=len(different))
                often = times >= 3  # in these few million bytes
                seen.update(dict(zip(different.filter(pa.array(often)).to_pylist(), times[often].tolist())))
                if len(seen) > 10 * TASK_ROWS:
                    seen = Counter(dict(seen.most_common(5 * TASK_ROWS)))
        top = [(t, n) for t, n in seen.most_common(TASK_ROWS) if len(t) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    counts = docs.select(text).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(rows)


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
                 table_rows: int = TABLE_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens`` of the whole text.

    A NULL text is empty and has no tokens. Rows may repeat, identifiers may be NULL;
    other columns take no part. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    none = np.zeros(0, np.int64)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(model.encode(b.column(0).to_pylist()), pa.int64())], names=["token", "n"])

    top = stored(frequent_pretokens(docs, "__text", table_rows).select("token"), "pretokens")
    # At most ``table_rows`` short strings.
    rows = top.repartition(8).mapInArrow(lengths, "token string, n long").collect()
    shared = spark.sparkContext.broadcast(([r.token for r in rows], np.array([r.n for r in rows], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes = shared.value
        model = worker_model(path)
        model.frequent, model.lengths = pa.array(tokens, pa.large_string()), sizes
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            n = [model.count(texts[start:stop]) for start, stop in slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(np.concatenate(n or [none]), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
