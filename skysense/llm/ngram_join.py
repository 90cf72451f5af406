"""Jaccard join of n-gram sets by prefix trees.

1. Every text becomes the set of its different n-grams, as 63-bit hashes, in one pass.
   Texts with the same set are one class, and its smallest document stands for it.
2. N-grams have a global order: those in the lowest part of the hash space, whose document
   counts are known, come first, rare ones before frequent ones, then all others. Two sets
   that are similar enough share one of the first few of their n-grams (prefix filter).
   N-grams that only one class has come first and link nothing.
3. Classes that share such an n-gram, directly or over others, form a cluster. A cluster
   of usual size is joined by one task. A larger one is cut into blocks, each joined with
   the next one; then only classes that still share an n-gram with a class of another
   component go on. These meet by the sizes of their sets, of which only neighbouring
   bands can be similar; where a band still has many, by all pairs of its blocks.
4. A join puts the ordered sets into a compressed prefix tree. A set walks down it: the
   overlap with a shared beginning is counted once for all sets below, and a subtree is
   left as soon as what remains can't reach the overlap that is needed, or holds no set
   that shares an n-gram of the prefix, may be similar by the parities of its n-grams in
   1024 classes, and isn't in the same component yet.
5. Components of the links are found by alternating stars.

A document's own n-grams are told apart by 63 bits; two different ones of the same or of a
compared document would have to collide to change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.llm.common import FILE, ROW, hinted, located, rows_at, slices, stored
from skysense.llm.components import components

#: The part of the hash space whose document counts are known, against the prefix's part of a set.
COUNTED = 2
#: Classes and n-grams of a block, and classes of a task, about.
BLOCK_SETS, BLOCK_GRAMS, TASK_SETS = 512, 1 << 20, 1_000
#: N-grams compared at a time on the way down.
STRIDE = 64
#: Bits of a set that tell most dissimilar ones apart before the tree is entered.
MARKS = 1024


@dataclass(frozen=True)
class Similar:
    """Sets of ``words``-grams link when intersection / union >= num / den."""

    words: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many first n-grams of a set of ``n`` must be looked at."""
        return n - -(-self.num * n // self.den) + 1

    @property
    def counted(self) -> int:
        """Hashes below this are counted."""
        return min(2**63 - 1, int(2**63 * COUNTED * (1 - self.num / self.den)))

    def needed(self, total):
        """The least overlap that links two sets of together ``total`` n-grams."""
        return -(-self.num * total // (self.num + self.den))

    def enough(self, overlap, total):
        """Whether ``overlap`` of two sets of together ``total`` n-grams links them."""
        return (self.num + self.den) * overlap >= self.num * total


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over their space."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text (no nulls) the sorted hashes of its different n-grams."""
    texts = texts.cast(pa.large_string())
    # Copied first, because ascii_lower reads the offsets of a slice wrongly.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(np.arange(len(texts))))))
    rows = pc.list_parent_indices(lists).to_numpy()
    flat = pc.list_flatten(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    rows, flat = rows[there.to_numpy(zero_copy_only=False)], flat.filter(there)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    h = hashes[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    counts = np.bincount(rows, minlength=len(texts))
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        grams = np.full(max(0, len(h) - words + 1), words, np.uint64)
        for k in range(words):
            grams = mixed(grams + h[k : len(h) - words + 1 + k])
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            n = end - start
            if n >= words:
                own = grams[start : end - words + 1]
            elif n:
                x = np.full(1, n, np.uint64)
                for k in range(start, end):
                    x = mixed(x + h[k : k + 1])
                own = x
            else:
                own = h[:0]
            yield np.unique(own >> np.uint64(1))


def digest_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def sets_of(docs: DataFrame, how: Similar) -> DataFrame:
    """Per row: a running number ``slot``, number of n-grams, digest of the set, the n-grams
    that may be in a prefix, and all columns but the text."""
    own = [f for f in docs.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = pc.fill_null(b.column("__text"), "")
            for start, stop in slices(texts):
                counts, digests, grams = [], [], []
                for s in gram_sets(texts[start:stop], how.words):
                    counts.append(len(s))
                    digests.append(digest_of(s.tobytes()))
                    low = int(np.searchsorted(s, np.uint64(how.counted)))
                    grams.append(s[: max(low, how.prefix(len(s)))].astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(slot, slot + len(counts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *[b.column(f.name)[start:stop] for f in own]],
                    names=["slot", "n", "digest", "grams", *[f.name for f in own]])
                slot += len(counts)

    return docs.mapInArrow(run, T.StructType([*T._parse_datatype_string(
        "slot long, n long, digest binary, grams array<long>").fields, *own]))


def prefixes(grams: DataFrame, how: Similar) -> DataFrame:
    """N-grams of the prefix of each class that other classes have as well: ``id``, ``n``,
    ``own`` (how many of its counted n-grams no other class has), ``gram``.

    ``grams`` has ``id``, ``n`` and the array ``grams`` of classes."""
    each = grams.select("id", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    low = F.col("gram") < how.counted
    own = each.join(shared, "gram").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct((~low).alias("high"), F.when(low, F.col("df")).alias("df"), "gram"))).alias("own"))
    counted = grams.select("id", "n", F.size("grams").alias("known"),
                           F.size(F.filter("grams", lambda g: g < how.counted)).alias("low"))
    joined = own.join(counted, "id")
    size = F.col("n") - F.ceil(F.lit(how.num) * F.col("n") / F.lit(float(how.den)) - 1e-9) + 1
    shared_low = F.size(F.filter("own", lambda g: ~g.high))
    # Counted n-grams without a second class come first. Where the prefix reaches beyond the
    # counted ones, it is all that was handed on.
    budget = F.when(F.col("low") >= size, size - (F.col("low") - shared_low)).otherwise(F.size("own"))
    # Only what each n-gram needs goes along when the array is spread out.
    picked = joined.withColumn("budget", budget.cast("int")).filter("budget > 0").select(
        "id", "n", (F.col("low") - shared_low).cast("long").alias("alone"),
        F.transform(F.slice("own", F.lit(1), F.greatest(F.col("budget"), F.lit(0))), lambda g: g.gram).alias("picked"))
    return picked.select("id", "n", "alone", F.explode("picked").alias("gram"))


def stars(postings: DataFrame, value: str) -> DataFrame:
    """Links of each class to the least ``value`` that has the same n-gram."""
    least = postings.groupBy("gram").agg(F.min(value).alias("b"), F.max(value).alias("most")).filter("b <> most")
    return postings.join(least, "gram").filter(F.col(value) != F.col("b")).select(F.col(value).alias("a"), "b").distinct()


class Tree:
    """A compressed prefix tree over sets in the order of their sequences.

    A node covers the sets ``lo`` to ``hi`` (exclusive), which share their first ``end``
    n-grams; those from ``start`` on are its own."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = len(sets)
        common = [0] * (n + 1)
        for i in range(1, n):
            a, b = sets[i - 1], sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[i] = int(differ[0]) if len(differ) else m
        sizes = np.array([len(s) for s in sets])
        self.nodes: list[tuple[int, int, int, int, int, int, list[int]]] = []
        # Ranges still to become nodes: (lo, hi, start, parent).
        todo = [(0, n, 0, -1)]
        while todo:
            lo, hi, start, parent = todo.pop()
            if hi - lo == 1:
                end, cuts = len(sets[lo]), []
            else:
                end = min(common[lo + 1 : hi])
                cuts = [i for i in range(lo + 1, hi) if common[i] == end]
            number = len(self.nodes)
            self.nodes.append((lo, hi, start, end, int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), []))
            if parent >= 0:
                self.nodes[parent][6].append(number)
            if hi - lo > 1:
                edges = [lo, *cuts, hi]
                todo += [(a, b, end, number) for a, b in zip(edges, edges[1:])]

    def search(self, x: np.ndarray, until: int, wanted: np.ndarray, how: Similar, found) -> None:
        """Call ``found(j)`` for the sets j < ``until`` that link with ``x``; ``wanted`` tells which count.

        ``found`` may clear entries of ``wanted``."""
        up, num, nx = how.num + how.den, how.num, len(x)
        stack = [(0, 0, 0)]  # node, overlap so far, place in x
        while stack:
            node, overlap, at = stack.pop()
            lo, hi, start, end, least, most, children = self.nodes[node]
            if lo >= until or not wanted[lo : min(hi, until)].any():
                continue
            s, dead = self.sets[lo], False
            while start < end:
                part = s[start : min(end, start + STRIDE)]
                start += len(part)
                to = at + int(np.searchsorted(x[at:], part[-1], side="right"))
                if to > at:
                    own = x[at:to]
                    places = np.searchsorted(own, part)
                    places[places == len(own)] = 0
                    overlap += int((own[places] == part).sum())
                    at = to
                # What remains of x, and of the largest and the smallest set below.
                if up * (overlap + nx - at) < num * (nx + max(least, start)) or up * (overlap + most - start) < num * (nx + most):
                    dead = True
                    break
            if dead:
                continue
            if hi - lo == 1:
                if how.enough(overlap, nx + len(s)):
                    found(lo)
            else:
                stack += [(c, overlap, at) for c in children]


def marks_of(s: np.ndarray) -> np.ndarray:
    """For each of ``MARKS`` classes of hashes, whether an odd number of n-grams is in it, as bits."""
    odd = np.bincount((s & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def link_sets(ids: list[int], labels: list[int], alone: list[int], sets: list[np.ndarray], heads: list[np.ndarray],
              how: Similar) -> list[tuple[int, int]]:
    """Links that join the components of these classes, as far as sets that share an n-gram of ``heads`` are similar.

    ``labels`` are components known already. Sets of one component aren't compared again.
    ``alone`` n-grams of a set are in no other set at all, so they can't be in an overlap."""
    order = sorted(range(len(ids)), key=lambda i: sets[i].astype(">u8").tobytes())
    tree = Tree([sets[i] for i in order])
    label = np.array([labels[i] for i in order], np.int64)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    reach = sizes - np.array([alone[i] for i in order], np.int64)
    marks = np.array([marks_of(sets[i]) for i in order])
    having: dict[int, list[int]] = {}
    links = []
    for i, k in enumerate(order):
        # Only sets before i are there yet: each pair is met once.
        near = np.zeros(len(order), bool)
        for g in heads[k].tolist():
            own = having.setdefault(g, [])
            near[own] = True
            own.append(i)
        n = len(sets[k])
        near &= how.enough(np.minimum(reach, reach[i]), sizes + n) & (label != label[i])
        some = np.flatnonzero(near)
        # Marks that differ are at most as many as n-grams that only one of two sets has.
        most = sizes[some] + n - 2 * how.needed(sizes[some] + n)
        near[some[np.bitwise_count(marks[some] ^ marks[i]).sum(axis=1) > most]] = False
        if not near.any():
            continue

        def found(j: int, i: int = i, k: int = k, near: np.ndarray = near) -> None:
            links.append((ids[k], ids[order[j]]))
            old, new = label[j], label[i]
            label[label == old] = new
            near &= label != new

        tree.search(sets[k], i, near, how, found)
    return links


@dataclass(frozen=True)
class Texts:
    """``docs`` (``id``, ``__text``), and for each class (``id``) its ``digest`` and a document ``doc``."""

    docs: DataFrame
    classes: DataFrame


def join_groups(members: DataFrame, texts: Texts, how: Similar) -> DataFrame:
    """Links (a, b) within groups. ``members`` has ``id``, ``label``, ``alone``, ``heads`` and ``groups``, the names of its groups.

    The sets are made anew from the texts of these classes only."""
    wanted = stored(members.select("id", "label", "alone", "heads", "groups").join(texts.classes, "id"), "members")
    total = wanted.agg(F.sum(F.size("groups"))).first()[0] or 0
    tasks = max(1, -(-int(total) // TASK_SETS))
    rows = texts.docs.withColumnRenamed("id", "doc").join(hinted(wanted, 1000), "doc")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pc.fill_null(b.column("__text"), "")
            for start, stop in slices(t):
                raw = [s.tobytes() for s in gram_sets(t[start:stop], how.words)]
                part = b.slice(start, stop - start)
                # Of rows that repeat an identifier, only those with this set.
                own = pa.array([digest_of(x) == d.as_py() for x, d in zip(raw, part.column("digest"))], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("id", "label", "alone", "heads", "groups")], pa.array(raw, pa.binary())],
                    names=["id", "label", "alone", "heads", "groups", "grams"]).filter(own)

    made = rows.select("id", "label", "alone", "heads", "groups", "digest", "__text").mapInArrow(
        make, "id long, label long, alone long, heads array<long>, groups array<string>, grams binary")
    spread = made.select("id", "label", "alone", "heads", "grams", F.explode("groups").alias("name")).withColumn(
        "task", F.pmod(F.xxhash64("name"), F.lit(tasks)))

    def link(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("name", "ascending"), ("id", "ascending")])
        group = group.take(order).combine_chunks()
        names = group.column("name").to_pylist()
        links: list[tuple[int, int]] = []
        start = 0
        while start < len(names):
            stop = start + 1
            while stop < len(names) and names[stop] == names[start]:
                stop += 1
            part = group.slice(start, stop - start)
            links += link_sets(
                part.column("id").to_pylist(), part.column("label").to_pylist(), part.column("alone").to_pylist(),
                [np.frombuffer(x.as_buffer(), np.uint64) for c in part.column("grams").chunks for x in c],
                [np.array(x, np.int64) for x in part.column("heads").to_pylist()], how)
            start = stop
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return stored(spread.groupBy("task").applyInArrow(link, "a long, b long"), "links")


def sized(postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Classes with the n-grams of their prefixes, their cluster, and into how many blocks it is cut."""
    classes = postings.groupBy("id", "n", "alone").agg(F.sort_array(F.collect_set("gram")).alias("heads"))
    named = (classes.join(clusters, classes["id"] == clusters["node"], "left")
             .select("id", "n", "alone", "heads", F.coalesce("component", "id").alias("cluster")))
    size = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS))
    return (named.join(size.filter("sets > 1").select("cluster", blocks.cast("long").alias("blocks")), "cluster")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))


def links_of(classes: DataFrame, texts: Texts, how: Similar) -> DataFrame:
    """Links whose components are those of all pairs of similar classes."""
    postings = stored(prefixes(classes, how), "postings")
    members = stored(sized(postings, components(stars(postings, "id"))), "clusters")
    cluster = F.concat(F.lit("c"), F.col("cluster"))
    before = F.pmod(F.col("block") - 1, F.col("blocks"))
    groups = F.when(F.col("blocks") == 1, F.array(cluster)).otherwise(F.array_distinct(F.array(
        F.concat_ws(":", cluster, F.col("block")), F.concat_ws(":", cluster, before))))
    first = join_groups(members.select("id", F.col("id").alias("label"), "alone", "heads", groups.alias("groups")), texts, how)
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return first
    # In large clusters: classes with an n-gram that classes of several components share.
    found = components(first)
    labelled = stored(large.join(found, F.col("id") == F.col("node"), "left").select(
        "id", "n", "alone", "cluster", "heads", F.coalesce("component", "id").alias("label")), "labelled")
    each = labelled.select("id", "label", F.explode("heads").alias("gram"))
    split = each.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("gram")
    left = stored(each.join(split, "gram").select("id", "gram"), "open")
    if left.isEmpty():
        return first
    opened = stored(left.groupBy("id").agg(F.sort_array(F.collect_set("gram")).alias("heads")).join(labelled.drop("heads"), "id"), "opened")
    return first.unionAll(join_groups(opened.join(meetings(opened, how), "id"), texts, how))


def meetings(classes: DataFrame, how: Similar) -> DataFrame:
    """Per class ``groups``, the names of the places where it meets those of its cluster it may be similar to."""
    ratio = float(np.log(how.den / how.num)) if how.num < how.den else 1.0
    # The larger of two similar sets has at most den / num times the n-grams: the next band.
    band = F.floor(F.log(F.col("n")) / F.lit(ratio) + 1e-9)
    placed = classes.select("id", "n", "cluster", F.explode(F.array(band, band + 1)).alias("band")).select(
        "id", "n", F.concat(F.lit("c"), F.col("cluster"), F.lit(":s"), F.col("band")).alias("place"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS))
    size = placed.groupBy("place").agg(blocks.alias("blocks"))
    cut = placed.join(size, "place").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # All pairs of blocks; a block meets itself in each of its pairs.
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: o != F.col("block"))
    names = F.when(F.col("blocks") == 1, F.array("place")).otherwise(F.transform(other, lambda o: F.concat_ws(
        ":", "place", F.least(o, F.col("block")), F.greatest(o, F.col("block")))))
    return cut.groupBy("id").agg(F.flatten(F.collect_list(names)).alias("groups"))


def grouped(rows: DataFrame, how: Similar) -> DataFrame:
    """``rows`` (``id``, ``__text`` and others) without the text, with ``n`` and ``group``, the same for rows of one component."""
    sets = stored(sets_of(rows, how), "sets")
    usable = sets.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # A class is named by the smallest number of its rows.
    first = stored(usable.groupBy("digest").agg(F.min("slot").alias("first"), F.min("id").alias("doc")), "classes")
    copies = stored(usable.select("slot", "digest").join(first, "digest").filter(F.col("slot") != F.col("first"))
                    .select("slot", "first"), "copies")
    classes = usable.join(hinted(copies, 32), "slot", "left_anti").select(F.col("slot").alias("id"), "n", "grams")
    texts = Texts(rows.select("id", "__text"), first.select(F.col("first").alias("id"), "digest", "doc"))
    found = stored(components(links_of(classes, texts, how)), "components")
    return (sets.drop("grams", "digest").join(hinted(copies, 32), "slot", "left")
            .withColumn("class", F.coalesce("first", "slot"))
            .join(hinted(found, 32), F.col("class") == F.col("node"), "left")
            .withColumn("group", F.coalesce("component", "class")).drop("slot", "first", "class", "node", "component"))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", how: Similar = Similar()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` (size of its set), ``component_id``.

    Letters A-Z are lowered, words stand between ASCII white space, and a text with fewer
    words than an n-gram is one n-gram. A NULL or empty text has an empty set, links with
    nothing, and is its own component. Rows that repeat an identifier are documents of
    their own. A row without identifier links with nothing and has no component (NULL).
    Other columns take no part. An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("__text"))
    named = stored(grouped(rows, how), "grouped")
    # Rows that are alone need no partner, so that only groups of several meet their least identifier.
    least = stored(named.groupBy("group").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
                   .filter("rows > 1").drop("rows"), "least")
    return named.join(hinted(least, 32), "group", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", how: Similar = Similar()) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest identifier, of equal
    ones the first in its file. Rows without words or without identifier stay."""
    names = docs.columns
    rows = located(docs)
    found = stored(grouped(rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("__text"), FILE, ROW), how), "grouped")
    least = stored(found.groupBy("group").agg(F.min(F.struct("id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("rows"))
                   .filter("rows > 1").select("group", F.col("keep")[FILE].alias("keep_file"), F.col("keep")[ROW].alias("keep_row")), "least")
    longest = least.agg(F.max(F.octet_length("keep_file"))).first()[0] or 0
    alone = F.col("keep_row").isNull()
    judged = stored(found.join(hinted(least, 48 + longest), "group", "left").select(FILE, ROW, (
        alone | (F.col("keep_file") == F.col(FILE)) & (F.col("keep_row") == F.col(ROW))).alias("kept")), "kept")
    return rows_at(rows, judged.filter("kept"), judged.filter("NOT kept")).select(*names)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
s AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM g),
e AS (SELECT doc_id, n, unnest(g) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, s.n AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""
