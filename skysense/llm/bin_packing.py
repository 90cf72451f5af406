"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are cut only where they are longer than a sequence; full pieces are sequences by
themselves, so one piece per document is to be packed. These are dealt over shards of some
thousand documents. A shard is solved by several islands, each a population of packings.
Crossover puts whole well-filled sequences of one parent into the child and takes the other
parent's sequences that share no document with them. What was displaced, and the documents of
the worst-filled sequences, first replace up to two documents of a sequence wherever that
fills it further (dominance); the rest is best-fitted.
Between epochs every island hands its best packing to the next one, by a shuffle. Epochs end
when no shard has gained for some of them; a shard at the lower bound takes no part in further
ones.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import slices, stored
from skysense.llm.encode import encoder

CAPACITY = 2048
#: Documents of a shard, about; islands of a shard; packings of an island.
SHARD_DOCS, ISLANDS, POPULATION = 4096, 2, 4
#: Generations of an epoch, and epochs without gain in any shard after which the search ends.
GENERATIONS, PATIENCE = 12, 2
#: Islands that a task solves, about. An epoch of one is often shorter than a task's start.
TASK_ISLANDS = 4
#: Displaced documents that are tried for a place in a sequence, by different sizes.
TRIED = 96
#: Sequences with more than this part of their room left are packed again across shards.
LOOSE = 1 / 8


class Packing:
    """Sequences as lists of items, with the space left in each."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []

    def add_bin(self, items: list[int], left: int) -> None:
        self.bins.append(items)
        self.left.append(left)

    def best_fit(self, items: list[int]) -> None:
        """Put each item where the least space remains, in the order given."""
        by_left: dict[int, list[int]] = {}
        mask = 0
        for b, free in enumerate(self.left):
            if free:
                by_left.setdefault(free, []).append(b)
                mask |= 1 << free
        sizes, bins, left = self.sizes, self.bins, self.left
        for i in items:
            size = sizes[i]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                open_bins = by_left[free]
                b = open_bins.pop()
                if not open_bins:
                    mask &= ~(1 << free)
                bins[b].append(i)
                free -= size
            else:
                b, free = len(bins), self.capacity - size
                bins.append([i])
                left.append(free)
            left[b] = free
            if free:
                by_left.setdefault(free, []).append(b)
                mask |= 1 << free

    def cost(self) -> tuple[int, int]:
        """Fewer sequences are better; then uneven filling, which leaves room in few of them."""
        return len(self.bins), -sum(x * x for x in self.left)

    def encode(self) -> list[int]:
        number = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                number[i] = b
        return number

    @classmethod
    def decode(cls, number: list[int], sizes: list[int], capacity: int) -> Packing:
        p = cls(sizes, capacity)
        n = max(number, default=-1) + 1
        p.bins, p.left = [[] for _ in range(n)], [capacity] * n
        for i, b in enumerate(number):
            p.bins[b].append(i)
            p.left[b] -= sizes[i]
        return p


def start(sizes: list[int], capacity: int, noise: random.Random | None) -> Packing:
    """Best-fit decreasing, or the same with disturbed sizes."""
    items = list(range(len(sizes)))
    key = [-s * (1 + noise.uniform(-0.15, 0.15)) for s in sizes] if noise else [-s for s in sizes]
    items.sort(key=key.__getitem__)
    p = Packing(sizes, capacity)
    p.best_fit(items)
    return p


class Pool:
    """Displaced items by size, with a bit per size that is present."""

    def __init__(self, items: list[int], sizes: list[int]):
        self.sizes, self.by_size, self.mask = sizes, {}, 0
        for i in items:
            self.add(i)

    def add(self, item: int) -> None:
        size = self.sizes[item]
        self.by_size.setdefault(size, []).append(item)
        self.mask |= 1 << size

    def take(self, size: int) -> int:
        items = self.by_size[size]
        item = items.pop()
        if not items:
            del self.by_size[size]
            self.mask &= ~(1 << size)
        return item

    def below(self, room: int) -> int:
        """The largest size that fits, 0 if none does."""
        return max(0, (self.mask & ((2 << room) - 1)).bit_length() - 1) if room > 0 else 0

    def best(self, low: int, room: int) -> tuple[int, ...]:
        """One or two sizes with the largest sum above ``low`` and up to ``room``."""
        one = self.below(room)
        top, found = (one, (one,)) if one > low else (low, ())
        if top == room:
            return found
        for n, a in enumerate(self.by_size):
            if n >= TRIED:
                break
            b = self.below(room - a)
            if b and a + b > top and (a != b or len(self.by_size[a]) > 1):
                top, found = a + b, (a, b)
                if top == room:
                    break
        return found

    def rest(self) -> list[int]:
        return [i for size in sorted(self.by_size, reverse=True) for i in self.by_size[size]]


def dominate(p: Packing, displaced: list[int]) -> list[int]:
    """Fill sequences further by displaced items, for up to two of their own; returns what is displaced then."""
    pool, sizes = Pool(displaced, p.sizes), p.sizes
    for k, own in enumerate(p.bins):
        if not p.left[k] or not pool.mask:
            continue
        few = sorted(own, key=sizes.__getitem__)[:6]
        swaps = [(), *((i,) for i in few), *((i, j) for n, i in enumerate(few) for j in few[:n])]
        gain, out, into = 0, (), ()
        for swap in swaps:
            low = sum(sizes[i] for i in swap)
            found = pool.best(low + gain, low + p.left[k])
            if found:
                gain, out, into = sum(found) - low, swap, found
                if gain == p.left[k]:
                    break
        if gain:
            own[:] = [i for i in own if i not in out] + [pool.take(size) for size in into]
            p.left[k] -= gain
            for i in out:
                pool.add(i)
    return pool.rest()


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Well-filled sequences of ``a``, what fits of ``b``'s, dominance and best fit for the rest."""
    order = sorted(range(len(a.bins)), key=lambda k: (a.left[k], rng.random()))
    whole = [(list(a.bins[k]), a.left[k]) for k in order[: max(1, int(len(order) * rng.uniform(0.2, 0.7)))]]
    injected = {i for own, _ in whole for i in own}
    kept = [(list(own), left) for own, left in zip(b.bins, b.left) if injected.isdisjoint(own)]
    displaced = [i for own in b.bins if not injected.isdisjoint(own) for i in own if i not in injected]
    # The worst-filled sequences that are left dissolve, so that their documents can move.
    kept.sort(key=lambda x: x[1])
    gone = rng.randint(1, max(1, (len(whole) + len(kept)) // 12))
    displaced += [i for own, _ in kept[max(0, len(kept) - gone):] for i in own]
    child = Packing(a.sizes, a.capacity)
    for own, left in whole + kept[: max(0, len(kept) - gone)]:
        child.add_bin(own, left)
    rng.shuffle(displaced)
    child.best_fit(dominate(child, displaced))
    return child


def evolve(sizes: list[int], numbers: list[list[int]], seed: int, *, capacity: int = CAPACITY,
           population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """An island's packings after some generations, the best one first.

    Stops when the best packing needs no more sequences than the sizes' sum does. A parent is
    the better of two packings drawn at random.
    """
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    own = [Packing.decode(x, sizes, capacity) for x in numbers]
    if len(own) < 2:
        own.append(start(sizes, capacity, None))
    if min(len(p.bins) for p in own) > least:
        while len(own) < population:
            own.append(start(sizes, capacity, rng))
    own.sort(key=Packing.cost)
    for _ in range(generations):
        if len(own[0].bins) <= least:
            break
        a = min(rng.sample(own, 2), key=Packing.cost)
        b = rng.choice([p for p in own if p is not a])
        own = sorted([*own, crossover(a, b, rng)], key=Packing.cost)[:population]
    return [p.encode() for p in own]


def tokenize(docs: DataFrame, path: str, end_id: int, *, key: str, text: str, capacity: int) -> DataFrame:
    """Per row: identifier, a running number, the number of ids with the end id, the checksums of its pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            sizes, sums = [], []
            for first, last in slices(texts):
                flat, counts = encoder(path).encode(texts[first:last])
                at = 0
                for n in counts.tolist():
                    ids = np.append(flat[at : at + n], end).astype("<u4")
                    at += n
                    sizes.append(n + 1)
                    sums.append([zlib.crc32(ids[k : k + capacity].tobytes()) for k in range(0, n + 1, capacity)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(range(slot, slot + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "slot", "n", "sums"])
            slot += len(sizes)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, slot long, n long, sums array<long>"), "tokens")


ISLAND = "shard long, island int, sizes array<int>, numbers array<array<int>>, used int, met boolean"


def solve(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """One epoch of every island; islands are rows and don't meet here.

    ``used`` is the best packing's number of sequences, ``met`` whether it is the lower bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())),
                          ("numbers", pa.list_(pa.list_(pa.int32()))), ("used", pa.int32()), ("met", pa.bool_())])
        for b in batches:
            for r in b.to_pylist():
                seed = (r["shard"] * 1009 + r["island"]) * 101 + epoch
                numbers = evolve(r["sizes"], r["numbers"] or [], seed, capacity=capacity)
                used = max(numbers[0], default=-1) + 1
                met = used <= -(-sum(r["sizes"]) // capacity)
                yield pa.RecordBatch.from_pylist([r | {"numbers": numbers, "used": used, "met": met}], schema=kind)

    return islands.mapInArrow(run, ISLAND)


def search(problems: DataFrame, islands: int, capacity: int, shards: int) -> DataFrame:
    """Per ``shard`` with its ``sizes`` and a first packing ``number`` (or NULL): the best packing found, as ``bins``.

    ``shards`` is about their number. Those at the lower bound stay out of later epochs.
    """
    first = F.when(F.col("number").isNull(), F.array().cast("array<array<int>>")).otherwise(F.array("number"))
    state = problems.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", first.alias("numbers"))
    epoch, settled, least, stale, ended = 0, 0, None, 0, None
    while True:
        tasks = max(1, -(-shards * islands // TASK_ISLANDS))
        state = stored(solve(state.repartition(tasks, "shard", "island"), epoch, capacity), f"epoch{epoch}")
        best = state.groupBy("shard").agg(F.min("used").alias("used"), F.bool_or("met").alias("met"))
        over, rest, shards = best.agg(
            F.sum(F.expr("if(met, used, 0)")), F.sum(F.expr("if(met, 0, used)")), F.count_if(~F.col("met"))).first()
        settled += over or 0
        now = settled + (rest or 0)
        stale = stale + 1 if least is not None and now >= least else 0
        epoch, least = epoch + 1, now
        last = not shards or stale >= PATIENCE
        # A shard that isn't in the last epoch has an island at the bound in an earlier one.
        done = (state if last else state.filter("met")).select("shard", "island", "used", F.col("numbers")[0].alias("bins"))
        ended = done if ended is None else ended.unionAll(done)
        if last:
            break
        to = F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")
        elites = state.groupBy("shard").agg(
            F.bool_or("met").alias("met"), F.collect_list(F.struct(to.alias("island"), F.col("numbers")[0].alias("guest"))).alias("elites")
        ).filter("NOT met").select("shard", F.inline("elites"))
        state = state.filter("NOT met").join(elites, ["shard", "island"]).select(
            "shard", "island", "sizes", F.array_distinct(F.concat(F.array("guest"), F.col("numbers"))).alias("numbers"))
    return ended.groupBy("shard").agg(F.min_by("bins", F.struct("used", "island")).alias("bins"))


def problem(items: DataFrame, number: str = "NULL") -> DataFrame:
    """Items (``shard``, ``place`` from 0, ``size``) gathered per shard, some thousand each."""
    return items.groupBy("shard").agg(F.sort_array(F.collect_list(F.expr(f"struct(place, size, {number} AS number)"))).alias("items")).select(
        "shard", F.col("items.size").alias("sizes"),
        F.lit(None).cast("array<int>").alias("number") if number == "NULL" else F.col("items.number").alias("number"))


def pack(docs: DataFrame, path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, islands: int = ISLANDS) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A NULL text is empty and still has the end id. Every row is packed, also repeated ones
    and those without identifier. Other columns take no part. An empty table gives an
    empty table. The packing depends only on rows and their order in the files. Sequences
    that a shard leaves with much room meet those of other shards in a second search, which
    starts from them and therefore never needs more.
    """
    tokens = tokenize(docs, path, end_id, key=key, text=text, capacity=capacity)
    shards = max(1, -(-tokens.count() // shard_docs))
    # The running numbers deal the rows evenly, whatever their identifiers are.
    dealt = tokens.withColumn("shard", F.pmod(F.col("slot") + F.shiftright("slot", 33) * 7919, F.lit(shards)))
    order = f"OVER (PARTITION BY shard ORDER BY n % {capacity} DESC, doc_id, slot"
    placed = stored(dealt.selectExpr(
        "*", f"cast(n % {capacity} AS int) AS size", f"row_number() {order}) - 1 AS place",
        f"coalesce(sum(n DIV {capacity}) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS full_before"), "placed")
    # A shard has about shard_docs rows. Documents without a rest come last in their order.
    rests = placed.filter("size > 0").select("shard", "place", "size")
    best = search(problem(rests), islands, capacity, shards)
    bins = stored(rests.join(best.select("shard", F.posexplode("bins").alias("place", "bin")), ["shard", "place"])
                  .withColumn("seq", F.shiftleft("shard", 32) + F.col("bin")), "bins")
    if shards > 1:
        loose = bins.groupBy("seq").agg(F.sum("size").alias("filled"), F.count("*").alias("items")).filter(
            F.col("filled") < (1 - LOOSE) * capacity)
        count = loose.agg(F.sum("items")).first()[0] or 0
        pools = max(1, -(-count // shard_docs))
        members = bins.join(loose.select("seq"), "seq").select(
            F.col("shard").alias("home"), F.col("place").alias("spot"), "seq", "size", F.pmod(F.xxhash64("seq"), F.lit(pools)).alias("shard"))
        pooled = stored(members.selectExpr(
            "*", "cast(row_number() OVER (PARTITION BY shard ORDER BY size DESC, seq, spot) - 1 AS int) AS place",
            "cast(dense_rank() OVER (PARTITION BY shard ORDER BY seq) - 1 AS int) AS old"), "pooled")
        again = search(problem(pooled, "old"), islands, capacity, pools)
        moved = pooled.join(again.select("shard", F.posexplode("bins").alias("place", "bin")), ["shard", "place"]).select(
            F.col("home").alias("shard"), F.col("spot").alias("place"), (F.shiftleft(F.col("shard") + shards, 32) + F.col("bin")).alias("new"))
        bins = bins.join(moved, ["shard", "place"], "left").withColumn("seq", F.coalesce("new", "seq"))
    # Documents of one sequence stand in it by their shards and places.
    before = bins.selectExpr("shard", "place", "seq", "sum(size) OVER (PARTITION BY seq ORDER BY shard, place) - size AS before")
    pieces = placed.join(before, ["shard", "place"], "left").select("*", F.posexplode("sums").alias("piece", "ids_crc32"))
    at = F.col("piece").cast("long") * capacity
    full = F.col("n") - at >= capacity
    alone = -1 - (F.shiftleft("shard", 32) + F.col("full_before") + F.col("piece"))
    return pieces.select(
        "doc_id", "piece", at.alias("start"), F.least(F.lit(capacity), F.col("n") - at).cast("long").alias("length"), "ids_crc32",
        F.when(full, alone).otherwise(F.col("seq")).cast("long").alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("before")).cast("long").alias("offset"))
