"""Phrase mining against counting by hand, and its odd cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skysense.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=30, first=2000):
    words, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        found = []
        for p, a in cand.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, le, r, words[lang], -s))
    return sorted(out)


def mined(docs, **how):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
                  for r in collocations.collocations(docs, **how).collect())


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["Of", "THE", "the", "of", "é", " x", "\U0001f600", "a", "b", "ÀB", "x\x00y", "in"]
    weights = [9, 3, 9, 5, 3, 1, 1, 3, 2, 1, 1, 2]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 80)):
            parts += [rng.choices(vocabulary, weights)[0], rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?", ",", "  "])]
        rows.append((i, "".join(parts), rng.choice(["en", "en", "en", None, "fr", ""])))
    rows += [(200 + i, "once more with feeling and the very same passage", "en") for i in range(70)]
    rows += [(7, None, "en"), (None, "", None), (8, " \t.,;", "de"), (9, "lone", "de"), (7, None, "en")]
    rows.append((300, "go " * 20_000 + "stop", "en"))
    return rows


@pytest.mark.parametrize("tasks", [1, 64])
def test_against_counting(spark, tasks):
    """With many tasks words, pairs and triples are too common for one and are counted in parts."""
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", phrase string, n int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        assert mined(docs) == plain(rows)
        assert mined(docs, least=2, first=5) == plain(rows, 2, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", None)], SCHEMA)).count() == 0


def test_quicksort_counts_prefixes(monkeypatch):
    """Partitions of every size, with small ones taken apart the same way."""
    rng = np.random.default_rng(2)
    for small, n in [(0, 400), (16, 3000), (1024, 20_000)]:
        monkeypatch.setattr(collocations, "SMALL", small)
        columns = [rng.zipf(1.6, n).clip(0, 60).astype(np.int32) for _ in range(4)]
        for d in range(1, 4):
            columns[d][(columns[d - 1] == 0) | (rng.random(n) < 0.1)] = 0
        counts = rng.integers(1, 4, n)
        want = Counter()
        for i in range(n):
            p = tuple(int(c[i]) for c in columns)
            for m in (2, 3, 4):
                if p[m - 1]:
                    want[p[:m]] += int(counts[i])
        got = list(collocations.multikey_quicksort(columns, counts, 30, 2))
        assert len(got) == len(dict(got)) and dict(got) == {p: k for p, k in want.items() if k >= 30}


def test_scores_beyond_64_bits(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("lang", __import__("pyspark").sql.functions.lit("en"))
    words, phrases = collocations.counted(docs, 1)
    assert words.count() == 2 and phrases.count() == 1
    from pyspark.sql import functions as F

    big = docs.select(F.expr("(cast(2000000 AS decimal(7,0)) * cast(9000000000000000000 AS decimal(20,0))) div "
                             "(cast(9000000000000000000 AS decimal(20,0)) + cast(9100000000000000000 AS decimal(20,0)))").alias("s"))
    assert big.first().s == 2_000_000 * 9_000_000_000_000_000_000 // 18_100_000_000_000_000_000
