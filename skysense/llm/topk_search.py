"""Exact top-k search by inner product, with a table of distances to pivots.

Vectors become integers, floor(1024 x). The distances of every vector to some pivots are
computed once and stored with it. By the triangle inequality the distance of a query and
a candidate is at least the largest difference of their distances to a pivot, and as

    q . c = (|q|^2 + |c|^2 - |q - c|^2) / 2,

that is an upper bound of their score. Candidates are evaluated in the order of this bound
until the next bound is below the k-th best score so far. Queries and candidates meet in
blocks of rows; a block of queries keeps its best scores from one block of candidates to
the next within a task.

Blocks hold vectors that lie near the same pivot. A block of candidates is cut into leaves
with the least and largest distance to each pivot, which bounds the scores of a leaf. Where
that leaves out few pairs of a block, the leaves that are left are evaluated at once. Scores
are products of matrices in single precision with a margin for their rounding; what passes
is evaluated in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysense.llm.common import stored

SCALE = 1024
#: Pivots, and the vectors (by the hashes of their identifiers) they are chosen among.
PIVOTS, PIVOT_SAMPLE = 32, 2_000
#: Rows of a block of candidates and of queries at most, and numbers in a block of either.
CANDIDATES, QUERIES, BLOCK_VALUES = 2_048, 512, 1 << 20
#: Numbers that wait in a task to be put in order by pivot.
WAITING_VALUES = 1 << 22
#: Rows of a leaf at most.
LEAF = 256
#: Candidates evaluated at a time where numbers are too large for doubles.
STEP = 64
#: Bytes of rows handed to Python at a time.
BATCH_BYTES = 8 << 20
#: Bytes of queries that a task holds while all candidates of its stripe pass.
GROUP_BYTES = 64 << 20
#: Distances are rounded to single precision; this is far above that, relative to them.
ROUNDED = 1e-6

BLOCK = "dim int, block long, n int, ids binary, vectors binary, norms binary, distances binary"


@contextmanager
def batches_of(spark: SparkSession, most: int):
    """Rows may be large while this lasts: hand about so many bytes of them to Python at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Identifiers and integer vectors of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    rows = vectors.filter(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    # Of rows that repeat an identifier, one: the smallest vector.
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length ``dim`` as rows."""
    return column.flatten().to_numpy().reshape(len(column), dim)


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows that come first by the hashes of their identifiers, chosen among the
    executors: a cut of the hash lets about twice as many pass, and is doubled until enough do."""
    n, share, hashed = rows.count(), 2 * sample, F.xxhash64("id")
    some = rows
    while share < n:
        some = rows.filter(hashed <= F.lit(share * 2**64 // n - 2**63))
        if some.count() >= sample:
            break
        some, share = rows, 2 * share
    return some.orderBy(hashed, "id").limit(sample)


def choose_pivots(rows: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """Per vector length: the origin and vectors that lie far from each other. One task
    chooses them, so that the driver gets the pivots alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                parts.setdefault(dim, []).append(matrix(b.column("v").filter(pa.array(lengths == dim)), dim))
        for dim, vectors in parts.items():
            own = np.concatenate(vectors).astype(np.float64)
            pivots = [np.zeros(dim)]
            far = np.linalg.norm(own, axis=1)
            while len(pivots) < count and far.max() > 0:
                pivots.append(own[far.argmax()])
                far = np.minimum(far, np.linalg.norm(own - pivots[-1], axis=1))
            yield pa.RecordBatch.from_pydict({"dim": [dim], "pivots": [np.array(pivots).astype("<f8").tobytes()], "n": [len(pivots)]}, schema=kind)

    kind = pa.schema([("dim", pa.int32()), ("pivots", pa.binary()), ("n", pa.int32())])
    # The limit leaves one partition.
    chosen = sampled(rows, sample).select("v").mapInArrow(run, "dim int, pivots binary, n int").collect()
    return {r.dim: np.frombuffer(r.pivots, "<f8").reshape(r.n, r.dim) for r in chosen}


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((v[:, None, :].astype(np.float64) - pivots[None]) ** 2).sum(axis=2)) if len(v) else np.zeros((0, len(pivots)))


def pack(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length with their norms and pivot distances.
    What a task has at hand is dealt to blocks in the order of nearest pivot and distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        values = 0

        def blocks(dim: int, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            own = pivots.get(dim, np.zeros((1, dim)))
            d = np.concatenate([distances(v[i : i + 256], own) for i in range(0, len(v), 256)])
            order = by_pivot(d)
            norms = (v.astype(np.float64) ** 2).sum(axis=1)
            step = max(1, min(size, BLOCK_VALUES // max(dim, 1)))
            for i in range(0, len(v), step):
                number, at = number + 1, order[i : i + step]
                yield pa.RecordBatch.from_pylist([{
                    "dim": dim, "block": number, "n": len(at), "ids": ids[at].astype("<i8").tobytes(), "vectors": narrow(v[at]).tobytes(),
                    "norms": norms[at].astype("<f8").tobytes(), "distances": d[at].astype("<f4").tobytes()}], schema=kind)

        def all_blocks() -> Iterator[pa.RecordBatch]:
            for dim, parts in waiting.items():
                yield from blocks(dim, *(np.concatenate(x) for x in zip(*parts)))

        kind = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *[
            (c, pa.binary()) for c in ("ids", "vectors", "norms", "distances")]])
        for b in batches:
            ids, lists = b.column("id").to_numpy(), b.column("v")
            lengths = lists.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                mine = lengths == dim
                waiting.setdefault(dim, []).append((ids[mine], matrix(lists.filter(pa.array(mine)), dim)))
            values += int(lengths.sum()) + len(lengths)
            if values >= WAITING_VALUES:
                yield from all_blocks()
                waiting, values = {}, 0
        yield from all_blocks()

    return rows.mapInArrow(run, BLOCK)


def by_pivot(d: np.ndarray) -> np.ndarray:
    """Rows in the order of their nearest pivot and their distance to it."""
    return np.lexsort((d.min(axis=1), d.argmin(axis=1)))


def largest(v: np.ndarray) -> int:
    """The largest absolute value, beyond what its type holds too."""
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest of 2, 4 and 8 bytes that holds them all."""
    most = largest(v)
    return v.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")


class Block:
    def __init__(self, r: dict):
        dim, n = r["dim"], r["n"]
        self.ids = np.frombuffer(r["ids"], "<i8")
        self.vectors = np.frombuffer(r["vectors"], f"<i{len(r['vectors']) // (n * dim) if dim else 8}").reshape(n, dim)
        self.norms = np.frombuffer(r["norms"], "<f8")
        self.distances = np.frombuffer(r["distances"], "<f4").reshape(n, -1)
        self.largest = largest(self.vectors)

    @cached_property
    def single(self) -> np.ndarray:
        return self.vectors.astype(np.float32)

    @cached_property
    def span(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances by pivot, rounded down and up."""
        by = np.ascontiguousarray(self.distances.T)
        return by * np.float32(1 - ROUNDED), by * np.float32(1 + ROUNDED)

    @cached_property
    def leaves(self) -> list[slice]:
        """Rows that follow each other and share their nearest pivot."""
        near = self.distances.argmin(axis=1)
        ends = [0, *(np.flatnonzero(np.diff(near)) + 1).tolist(), len(near)]
        return [slice(i, min(i + LEAF, b)) for a, b in zip(ends, ends[1:]) for i in range(a, b, LEAF)]

    @cached_property
    def reach(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per leaf: least and largest distance to each pivot, rounded outward, and the largest norm."""
        return (np.stack([self.distances[x].min(axis=0) for x in self.leaves]) * np.float32(1 - ROUNDED),
                np.stack([self.distances[x].max(axis=0) for x in self.leaves]) * np.float32(1 + ROUNDED),
                np.array([self.norms[x].max() for x in self.leaves]))


def scores(q: np.ndarray, c: np.ndarray, safe: float) -> np.ndarray:
    """Exact inner products: in doubles while all sums fit their 53 bits, else in integers."""
    if safe < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if safe < 2**63:
        return c.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, q)) for x in c], dtype=object).astype(np.int64)


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.evaluated = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        keep = s >= self.least
        ids, s = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, s[keep]])
        order = np.lexsort((ids, -s))[: self.k]
        self.ids, self.scores = ids[order], s[order]


def search_block(q: Block, c: Block, best: list[Best]) -> None:
    """Bring the candidates of ``c`` into the results of the queries of ``q``."""
    dim = q.vectors.shape[1]
    safe = float(dim) * max(q.largest, 1) * max(c.largest, 1)
    for i, result in enumerate(best):
        gap = (np.abs(c.distances - q.distances[i]) - ROUNDED * (c.distances + q.distances[i])).max(axis=1, initial=0).astype(np.float64)
        total = q.norms[i] + c.norms
        bound = (total - gap * gap) / 2 + 1 + ROUNDED * total
        order = np.flatnonzero(bound >= result.least)
        order = order[np.argsort(-bound[order], kind="stable")]
        order = order[c.ids[order] != q.ids[i]]
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if bound[part[0]] < result.least:
                break
            result.evaluated += len(part)
            result.add(c.ids[part], scores(q.vectors[i], c.vectors[part], safe))


class Found:
    """The k best (score, id) of each query of a block so far; places not taken are NOTHING."""

    NOTHING = (-(2**63 - 1), 2**63 - 1)

    def __init__(self, n: int, k: int):
        self.k, self.counts, self.evaluated = k, np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.scores, self.ids = (np.full((n, k), x, np.int64) for x in self.NOTHING)

    @property
    def least(self) -> np.ndarray:
        return np.where(self.counts == self.k, self.scores[:, -1], -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Candidates ``ids`` with scores ``s`` for the queries at ``rows``."""
        who, more = np.unique(rows, return_counts=True)
        rows = np.concatenate([np.repeat(who, self.k), rows])
        ids, s = np.concatenate([self.ids[who].ravel(), ids]), np.concatenate([self.scores[who].ravel(), s])
        order = np.lexsort((ids, -s, rows))
        ends = np.cumsum(more + self.k)
        first = order[((ends - more - self.k)[:, None] + np.arange(self.k)).ravel()]
        self.ids[who], self.scores[who] = ids[first].reshape(-1, self.k), s[first].reshape(-1, self.k)
        self.counts[who] = np.minimum(self.counts[who] + more, self.k)

    def lists(self) -> list[Best]:
        out = [Best(self.k) for _ in self.counts]
        for i, (b, n) in enumerate(zip(out, self.counts)):
            b.ids, b.scores, b.evaluated = self.ids[i, :n], self.scores[i, :n], int(self.evaluated[i])
        return out

    def take(self, lists: list[Best]) -> None:
        for i, b in enumerate(lists):
            n = len(b.ids)
            self.ids[i, :n], self.scores[i, :n], self.counts[i], self.evaluated[i] = b.ids, b.scores, n, b.evaluated


def leaf_bounds(q: Block, c: Block) -> np.ndarray:
    """Per query and leaf of ``c`` an upper bound of the scores."""
    (near, far), (low, high, norms) = q.span, c.reach
    gap = np.stack([np.maximum(near - b[:, None], a[:, None] - far).max(axis=0, initial=0) for a, b in zip(low, high)], axis=1).astype(np.float64)
    total = q.norms[:, None] + norms
    return (total - gap * gap) / 2 + 1 + ROUNDED * total


def search_leaves(q: Block, c: Block, found: Found) -> None:
    """Bring the candidates of ``c`` into the results of the queries of ``q``: as ``search_block``, many pairs at a time."""
    dim = q.vectors.shape[1]
    if float(dim) * max(q.largest, 1) * max(c.largest, 1) >= 2**53:
        lists = found.lists()
        search_block(q, c, lists)
        found.take(lists)
        return
    bound, least = leaf_bounds(q, c), found.least
    size, some = np.array([x.stop - x.start for x in c.leaves]), bound >= least[:, None]
    left, rows = np.flatnonzero(some.any(axis=0)), np.flatnonzero(some.any(axis=1))
    if least.min() > -np.inf and (some[:, left] @ size[left]).sum() > 0.5 * len(rows) * size[left].sum():
        # Most queries need most of what is left, so that its order spares little.
        at = slice(0, len(c.ids)) if len(left) == len(c.leaves) else np.concatenate([np.arange(c.leaves[x].start, c.leaves[x].stop) for x in left])
        evaluate(q, c, rows, at, found)
        return
    for x in left[np.argsort(-bound[:, left].max(axis=0), kind="stable")]:
        rows = np.flatnonzero(bound[:, x] >= found.least)
        if len(rows):
            evaluate(q, c, rows, c.leaves[x], found)


def evaluate(q: Block, c: Block, rows: np.ndarray, at: slice | np.ndarray, found: Found) -> None:
    """Scores of the queries ``rows`` and the candidates ``at``, whose sums fit a double."""
    dim, every = q.vectors.shape[1], len(rows) == len(q.ids)
    s = (q.single if every else q.single[rows]) @ c.single[at].T
    least, n = found.least[rows], s.shape[1]
    # Whatever the order of the sum, its rounding stays below dim units of the product of the norms.
    error = (dim + 4) * 2.0**-23 * np.sqrt(q.norms[rows] * c.norms[at].max(initial=0))
    enough = least - error
    if n > found.k + 1 and (new := np.flatnonzero(least == -np.inf)).size:
        # One more than k, as the query itself may be among them.
        enough[new] = np.partition(s[new], n - found.k - 1, axis=1)[:, n - found.k - 1] - 2 * error[new]
    enough = np.nextafter(enough.astype(np.float32), np.float32(-np.inf))
    found.evaluated[rows] += n
    hit = np.flatnonzero(s.max(axis=1) >= enough)
    r, x = np.divmod(np.flatnonzero(s[hit] >= enough[hit, None]), n)
    r, x = rows[hit[r]], x + at.start if isinstance(at, slice) else at[x]
    ids = c.ids[x]
    keep = ids != q.ids[r]
    r, x, ids = r[keep], x[keep], ids[keep]
    exact = np.einsum("ij,ij->i", q.vectors[r].astype(np.float64), c.vectors[x].astype(np.float64))
    keep = exact >= found.least[r]
    if keep.any():
        found.add(r[keep], ids[keep], exact[keep].astype(np.int64))


RESULT = "query_id long, vec_id long, score long, evaluated long"


def search_parts(k: int):
    """Of each vector length, first blocks of queries come (side 0), then blocks of candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple[Block, Found]] = []
        dim = None

        def done() -> Iterator[pa.RecordBatch]:
            for q, found in queries:
                taken = np.arange(k) < found.counts[:, None]
                if taken.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                        np.repeat(q.ids, found.counts), found.ids[taken], found.scores[taken], np.repeat(found.evaluated, found.counts))],
                        names=["query_id", "vec_id", "score", "evaluated"])

        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i].as_py() for name in b.schema.names}
                if r["dim"] != dim:
                    yield from done()
                    queries, dim = [], r["dim"]
                block = Block(r)
                if r["side"] == 0:
                    queries.append((block, Found(len(block.ids), k)))
                else:
                    for q, found in queries:
                        search_leaves(q, block, found)
        yield from done()
    return run


def topk(vectors: DataFrame, is_query: Column, k: int = 10, *, key: str = "vec_id", vector: str = "embedding",
         pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """Per query its ``k`` best other vectors: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``is_query`` tells by the identifier (column ``id``) which vectors are queries. Ties go
    to the smaller identifier. Vectors that are NULL, hold a NULL or aren't finite, and
    rows without identifier, take no part; of rows that repeat an identifier one does.
    Vectors are compared with vectors of the same length. Other columns take no part.
    Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, key, vector), "vectors")
    anchors = choose_pivots(rows, pivots, pivot_sample)
    asked = rows.filter(is_query)
    n, (m, held) = rows.count(), asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(4 * F.size("v") + 256 + 24 * k), F.lit(0))).first()
    # A task holds one group of the queries and meets one stripe of the candidates. Each stripe costs a copy of the
    # queries and results of its own, each group a copy of the candidates.
    groups = max(1, -(-held // GROUP_BYTES))
    stripes = max(-(-4 * spark.sparkContext.defaultParallelism // groups), n // max(1, 2 * m))
    stripes = max(1, min(stripes, -(-n // LEAF), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = max(LEAF, min(CANDIDATES, n // (8 * stripes)))
    queries = (pack(asked.repartition(groups), anchors, QUERIES).withColumn("side", F.lit(0)).withColumn("group", F.expr("shiftright(block, 33)"))
               .withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))))
    # The blocks of a task go to stripes that follow each other.
    candidates = (pack(rows, anchors, size).withColumn("side", F.lit(1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
                  .withColumn("stripe", F.expr(f"pmod(xxhash64(shiftright(block, 33)) + (block & {2**33 - 1}), {stripes})")))
    met = queries.unionByName(candidates).withColumn("part", (F.col("group") * stripes + F.col("stripe")).cast("int")).drop("group", "stripe")
    with batches_of(spark, BATCH_BYTES):
        found = stored(met.repartitionById(groups * stripes, "part").sortWithinPartitions("dim", "side")
                       .mapInArrow(search_parts(k), RESULT), "found")
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
