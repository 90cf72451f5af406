r"""Phrases of two to four words that occur together more often than their parts suggest.

1. A first pass counts words. It also adds up which leading pairs and triples are so common
   that one task shouldn't get all suffixes that begin with them.
2. A second pass takes a pointer to every word as the suffix that begins there, at most four
   words long, and sends it to a task by its leading word; by its leading two, three or four
   words where fewer are too common. So each task has all suffixes with its leading words.
3. There, a multikey three-way quicksort orders the pointers word by word. The equal
   partition of a step is a phrase and its size is the phrase's count; a partition that is
   smaller than the least count is abandoned, because no phrase in it can reach it.
4. Cuts, scores and the phrases that a longer one covers are joins of what was counted.

Within a slice of texts equal suffixes travel once, with their number. Words go as codes of a
dictionary per slice and task, so nothing depends on hashes but the choice of the task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import slices, stored

#: Longest phrase in words.
DEPTH = 4
#: Suffixes that one task sorts at a time, about.
TASK_WORDS = 4_000_000
#: A prefix with less than this share of a slice isn't told of; so few can be common.
COMMON = 1 << 16
SLICE_BYTES = 16 << 20
#: Words are looked up among the frequent ones in a table of so many bits, whatever their number;
#: an infrequent word that shares a bit with a frequent one only costs time.
BITS = 25
#: Below this many pointers a partition is ordered at once.
SMALL = 1024
#: What separates pieces of text, what separates words, and lower case.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

_WORD = np.ones(256, bool)
_WORD[list(BREAKS + SPACES)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts of one language: codes, their pieces, and the dictionary."""

    def __init__(self, texts: pa.Array, lang: str):
        import xxhash

        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        begins = (ends[:-1] - ends[0])[ends[:-1] < ends[1:]]
        word, cut = _WORD[raw], _BREAK[raw]
        cut[begins] = True
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[begins] = word[begins]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[begins[1:] - 1] = word[begins[1:] - 1]
        starts = np.flatnonzero(first)
        offsets = np.append(0, np.cumsum(np.flatnonzero(last) - starts + 1))
        self.piece = np.searchsorted(np.flatnonzero(cut), starts, side="right").astype(np.int32)
        # Only letters of words are kept, so a word ends where the next one begins.
        found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        found = found.dictionary_encode()
        self.codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.names = found.dictionary
        self.lang = lang
        # As Spark's xxhash64(lang, word).
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.names))

    def keep(self, wanted: np.ndarray) -> None:
        """Forget the other words; their places get the code -1."""
        self.codes = np.where(wanted, np.cumsum(wanted) - 1, -1).astype(np.int32)[self.codes]
        self.names, self.hashes = self.names.filter(pa.array(wanted)), self.hashes[wanted]

    def follows(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The code ``k`` words on, or -1 where the piece ends before; -1 stays -1."""
        ahead = np.full(len(codes), -1, np.int32)
        if len(codes) > k:
            ahead[:-k] = np.where(self.piece[k:] == self.piece[:-k], codes[k:], -1)
        return ahead


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for b in batches:
        texts, langs = b.column("__text"), b.column("__lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for start, stop in slices(texts, SLICE_BYTES):
            part, ids = texts.slice(start, stop - start), which[start:stop]
            for i in np.unique(ids):
                yield Words(part.filter(pa.array(ids == i)), langs.dictionary[int(i)].as_py())


def prefix_hash(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one more word."""
    mixed = (before ^ (before >> np.uint64(29))) * _MIX
    return (mixed ^ (mixed >> np.uint64(32))) + hashes


def _grow(before: np.ndarray, words: Words, codes: np.ndarray) -> np.ndarray:
    return prefix_hash(before, words.hashes[codes])


COUNTS = "lang string, word string, size int, hash long, n long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: its words; and hashes of its common pairs and triples, without a word."""
    names = ["lang", "word", "size", "hash", "n"]

    def rows(lang, word, size, hashes, n):
        k = len(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), word, pa.array(np.full(k, size, np.int32)), hashes, pa.array(n.astype(np.int64))], names=names)

    for w in by_language(batches):
        if not len(w.codes):
            continue
        # The hash of a word is made again after the counts are added up.
        yield rows(w.lang, w.names.cast(pa.string()), 1, pa.nulls(len(w.names), pa.int64()), np.bincount(w.codes, minlength=len(w.names)))
        least = max(2, len(w.codes) // COMMON)
        here = np.arange(len(w.codes))
        prefix = w.hashes[w.codes]
        for size in (2, 3):
            ahead = w.follows(w.codes, size - 1)[here]
            here, prefix = here[ahead >= 0], _grow(prefix[ahead >= 0], w, ahead[ahead >= 0])
            found, n = np.unique(prefix, return_counts=True)
            many = n >= least
            if many.any():
                yield rows(w.lang, pa.nulls(int(many.sum()), pa.string()), size, pa.array(found[many].view(np.int64)), n[many])


class Routes:
    """Which task a suffix goes to."""

    def __init__(self, tasks: int, frequent: np.ndarray, common: list[np.ndarray]):
        self.tasks, self.frequent, self.common = tasks, frequent, common

    def is_frequent(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - BITS + 6)).astype(np.int64)
        return (self.frequent[slot] >> (hashes & np.uint64(63))) & np.uint64(1) == 1

    def lead(self, words: Words, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """By how many leading words each suffix is routed, and the hashes of its prefixes."""
        n = len(columns[0])
        prefixes = [words.hashes[columns[0]]]
        for c in columns[1:]:
            prefixes.append(np.where(c >= 0, _grow(prefixes[-1], words, c), prefixes[-1]))
        lead, open_ = np.ones(n, np.int8), np.ones(n, bool)
        for size, common in enumerate(self.common, 1):
            open_ &= np.isin(prefixes[size - 1], common) if len(common) else False
            lead[open_] = size + 1
        return lead, prefixes


SUFFIXES = "task int, lang string, lead int, lengths binary, letters binary, codes binary, counts binary"


def send_suffixes(routes) -> callable:
    """Per slice, task, and number of leading words: its suffixes, each once with its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        to = routes.value
        press = zstandard.ZstdCompressor(1)
        for w in by_language(batches):
            if not len(w.codes):
                continue
            w.keep(to.is_frequent(w.hashes))
            columns = [w.codes]
            for k in range(1, DEPTH):
                # A phrase ends before an infrequent word.
                columns.append(np.where(columns[-1] >= 0, w.follows(w.codes, k), -1))
            some = np.flatnonzero(columns[1] >= 0)
            columns, counts = distinct([c[some] for c in columns], len(w.names))
            if not len(counts):
                continue
            lead, prefixes = to.lead(w, columns)
            groups = [(columns, counts, lead, prefixes)]
            # A prefix that isn't complete in any task is counted here, and travels as a suffix of its own.
            for size in (2, 3):
                short = (lead > size) & (columns[size - 1] >= 0)
                if short.any():
                    cut = [c[short] if i < size else np.full(int(short.sum()), -1, np.int32) for i, c in enumerate(columns)]
                    cut, n = distinct(cut, len(w.names), counts[short])
                    groups.append((cut, n, np.full(len(n), size, np.int8), to.lead(w, cut)[1]))
            yield from packed(w, to.tasks, groups, press)

    return run


def distinct(columns: list[np.ndarray], size: int, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different suffixes in order, and how often each occurs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if weights is None and size < 1 << 16:
        # Four codes are one number, and so sorted without pointers.
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = (key << np.uint64(16)) | (c + 1).astype(np.uint64)
        key, counts = np.unique(key, return_counts=True)
        return [((key >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.int32) - 1 for d in reversed(range(DEPTH))], counts
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key * (size + 1) + (c + 1)
        if c is not columns[-1]:
            key = np.unique(key, return_inverse=True)[1]
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights).astype(np.int64)
    return [c[at] for c in columns], counts


def to_blob(press, numbers: np.ndarray) -> bytes:
    """Numbers with their width, all lowest bytes first: the others are mostly zeros."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return press.compress(bytes([width]) + planes.tobytes())


def from_blob(unpress, blob: bytes) -> np.ndarray:
    raw = unpress.decompress(blob)
    width = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def packed(w: Words, tasks: int, groups, press) -> Iterator[pa.RecordBatch]:
    out = []
    for columns, counts, lead, prefixes in groups:
        whole = np.choose(lead - 1, prefixes)
        task = (prefix_hash(whole, np.uint64(1)) % np.uint64(tasks)).astype(np.int64)
        # Shorter than its leading words: nothing of it is asked for.
        asked = np.choose(lead - 1, columns) >= 0
        order = np.flatnonzero(asked)
        order = order[np.argsort((task * (DEPTH + 1) + lead)[order], kind="stable")]
        key = (task * (DEPTH + 1) + lead)[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            mine = order[a:b]
            table = np.stack([c[mine] for c in columns])
            used, local = np.unique(table, return_inverse=True)
            shift = 1 if used[0] >= 0 else 0  # code 0 is the end
            local = local.reshape(table.shape) + shift
            names = w.names.take(pa.array(used[used >= 0]))
            letters, ends = names.buffers()[2], np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
            out.append((int(task[mine[0]]), w.lang, int(lead[mine[0]]), to_blob(press, np.diff(ends)),
                        press.compress(letters.to_pybytes()[: ends[-1]] if letters else b""), to_blob(press, local.ravel()), to_blob(press, counts[mine])))
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4]
    names = ["task", "lang", "lead", "lengths", "letters", "codes", "counts"]
    for i in range(0, len(out), 256):
        cols = zip(*out[i : i + 256])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def multikey_quicksort(columns: list[np.ndarray], counts: np.ndarray, least: int, shortest: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Prefixes of at least ``shortest`` words that occur ``least`` times or more, with their counts.

    ``columns`` are the words of the suffixes by depth, 0 beyond the end. Pointers are
    partitioned in place into smaller, equal and greater by the word at one depth; the equal
    ones go on with the next depth.
    """
    rng = random.Random(len(counts))
    pointers = np.arange(len(counts), dtype=np.int32)
    stack = [(0, len(pointers), 0, ())]
    while stack:
        lo, hi, depth, prefix = stack.pop()
        mine = pointers[lo:hi]
        if hi - lo <= SMALL:
            yield from small_partition(columns, counts, mine, depth, prefix, least, shortest)
            continue
        keys = columns[depth][mine]
        pivot = sorted(int(keys[rng.randrange(hi - lo)]) for _ in range(9))[4]
        less, equal, more = mine[keys < pivot], mine[keys == pivot], mine[keys > pivot]
        a, b = lo + len(less), hi - len(more)
        pointers[lo:a], pointers[a:b], pointers[b:hi] = less, equal, more
        for begin, end, part in ((lo, a, less), (b, hi, more)):
            # An infrequent partition is abandoned.
            if end - begin >= least or (end > begin and counts[part].sum() >= least):
                stack.append((begin, end, depth, prefix))
        if pivot:
            n = int(counts[equal].sum())
            if n >= least:
                phrase = (*prefix, pivot)
                if len(phrase) >= shortest:
                    yield phrase, n
                if depth + 1 < len(columns):
                    stack.append((a, b, depth + 1, phrase))


def small_partition(columns, counts, mine, depth, prefix, least, shortest) -> Iterator[tuple[tuple[int, ...], int]]:
    """What is left of a small partition: ordered at once, word by word; runs of equals are its partitions."""
    weights = counts[mine]
    if weights.sum() < least:
        return
    order = np.lexsort([c[mine] for c in reversed(columns[depth:])])
    mine, weights = mine[order], weights[order]
    upto = np.append(0, np.cumsum(weights))
    fresh = np.zeros(len(mine), bool)
    fresh[0] = True
    alive = np.ones(len(mine), bool)
    tail: list[np.ndarray] = []
    for c in columns[depth:]:
        keys = c[mine]
        tail.append(keys)
        fresh[1:] |= keys[1:] != keys[:-1]
        starts = np.flatnonzero(fresh)
        n = np.diff(np.append(upto[starts], upto[-1]))
        good = (n >= least) & (keys[starts] > 0) & alive[starts]
        if len(prefix) + len(tail) >= shortest:
            for s, k in zip(starts[good], n[good]):
                yield (*prefix, *(int(t[s]) for t in tail)), int(k)
        if not good.any():
            return
        alive = np.repeat(good, np.diff(np.append(starts, len(mine))))


PHRASES = "lang string, phrase string, size int, n long"


def sort_suffixes(least: int):
    """The frequent phrases of each task's suffixes, which come ordered by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()

        def suffixes(lengths, letters, codes) -> pa.DictionaryArray:
            """The words of suffixes, depth after depth; the empty word is the end."""
            ends = np.append(np.zeros(2, np.int64), np.cumsum(from_blob(unpress, lengths).astype(np.int64)))
            names = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(unpress.decompress(letters))])
            return pa.DictionaryArray.from_arrays(pa.array(from_blob(unpress, codes).astype(np.int32)), names)

        def finish(key, parts, counts):
            if key is None:
                return
            _, lang, lead = key
            # The dictionaries become one; the empty word is the first of all.
            parts = pa.chunked_array(parts).unify_dictionaries().chunks
            names = parts[0].dictionary
            tables = [p.indices.to_numpy().reshape(DEPTH, -1) for p in parts]
            columns = [np.concatenate([t[d] for t in tables]) for d in range(DEPTH)]
            del parts, tables
            phrases, sizes, ns = [], [], []
            for phrase, n in multikey_quicksort(columns, np.concatenate(counts), least, max(2, lead)):
                phrases.append(" ".join([names[i].as_py() for i in phrase]))
                sizes.append(len(phrase))
                ns.append(n)
                if len(ns) == 50_000:
                    yield phrase_rows(lang, phrases, sizes, ns)
                    phrases, sizes, ns = [], [], []
            if ns:
                yield phrase_rows(lang, phrases, sizes, ns)

        key, parts, counts = None, [], []
        for b in batches:
            for task, lang, lead, *blobs, count in zip(*[b.column(i) for i in range(7)]):
                now = (task.as_py(), lang.as_py(), lead.as_py())
                if now != key:
                    yield from finish(key, parts, counts)
                    key, parts, counts = now, [], []
                parts.append(suffixes(*[x.as_py() for x in blobs]))
                counts.append(from_blob(unpress, count.as_py()).astype(np.int64))
        yield from finish(key, parts, counts)

    return run


def phrase_rows(lang, phrases, sizes, ns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(ns), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64())],
        names=["lang", "phrase", "size", "n"])


def counted(docs: DataFrame, least: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All words with their counts, and the phrases that occur ``least`` times or more; both stored."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("__lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    found = stored(texts.mapInArrow(count_words, COUNTS).groupBy("lang", "word", "size", "hash").agg(F.sum("n").alias("n")), "words")
    words = found.filter("size = 1").select("lang", "word", F.xxhash64("lang", "word").alias("hash"), "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    # Of each size at most COMMON prefixes are so common.
    often = F.col("n") > max(total // COMMON, total // (16 * tasks))
    common = found.filter(often).select("size", F.coalesce("hash", F.xxhash64("lang", "word")).alias("hash")).toArrow()
    sizes, hashes = (common.column(i).to_numpy() for i in range(2))
    bits = (words.filter(F.col("n") >= least)
            .select(F.shiftrightunsigned("hash", 64 - BITS + 6).cast("int").alias("slot"), F.expr("shiftleft(1L, int(hash & 63))").alias("bit"))
            .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow())
    frequent = np.zeros(1 << (BITS - 6), np.uint64)
    frequent[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
    routes = spark.sparkContext.broadcast(Routes(tasks, frequent, [np.sort(hashes[sizes == s].view(np.uint64)) for s in (1, 2, 3)]))
    sent = texts.mapInArrow(send_suffixes(routes), SUFFIXES)
    phrases = (sent.repartition(tasks, "task").sortWithinPartitions("task", "lang", "lead")
               .mapInArrow(sort_suffixes(least), PHRASES))
    return words, stored(phrases, "phrases")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", *, least: int = 30, covered: tuple[int, int] = (80, 100),
                 first: int = 2000) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases occur at least ``least`` times within pieces of text. ``a`` is a phrase's count,
    ``l`` and ``r`` those of both sides of its lowest-scoring cut, ``n`` the language's words,
    ``score`` is floor(2,000,000 a / (l + r)) in exact arithmetic. A phrase that stands inside
    a longer one with ``covered`` of its count is left out. NULL texts are empty, a NULL
    language is ``und``; repeated rows count as often as they occur; other columns take no
    part. An empty table gives an empty table.
    """
    words, phrases = counted(docs, least, lang, text)
    known = stored(phrases.select("lang", "phrase", "n").unionByName(
        words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")), "known")
    split = F.split("phrase", " ")
    ks = F.sequence(F.lit(1), F.col("size") - 1)
    side = lambda name, begin, count: F.array_join(F.slice(split, begin, count), " ").alias(name)
    cuts = (phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(ks).alias("k"))
            .select("lang", "phrase", "a", "k", side("left", F.lit(1), F.col("k")), side("right", F.col("k") + 1, F.col("size") - F.col("k"))))
    part = lambda name, n: known.select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    valued = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(2000000 AS decimal(7,0)) * cast(a AS {wide})) div (cast(l AS {wide}) + cast(r AS {wide}))")
    lowest = valued.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    # What stands inside longer phrases, with the largest count of those.
    inner = phrases.filter("size > 2").select("lang", "n", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    num, den = covered
    best = (lowest.join(covers, ["lang", "phrase"], "left")
            .filter(F.coalesce(F.expr(f"cast({den} AS {wide}) * longer < cast({num} AS {wide}) * cut.a"), F.lit(True)))
            .select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    top = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y
  FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
v AS (SELECT k.lang, k.phrase, k.a, k.k, fx.f AS l, fy.f AS r, ((2000000::HUGEINT * a) // (fx.f + fy.f))::BIGINT AS score
  FROM k JOIN f fx ON fx.lang = k.lang AND fx.phrase = k.x JOIN f fy ON fy.lang = k.lang AND fy.phrase = k.y),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, w, m, unnest(range(1, m + 1)) AS i FROM c),
j AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
  FROM i, (SELECT unnest([2, 3]) AS z) WHERE z < m AND i + z - 1 <= m GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN j USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000"""
