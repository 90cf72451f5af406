"""The pipeline's stages one by one against a plain version, on planted copies, near copies and toxic documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skysense.llm.encode import tokenizer_path

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo") for c in ("n", "d", "st", "m", "l", "rk")]
VILE, SPAM = ["scum", "vermin", "filthy", "worthless", "idiot"], ["cheap", "click", "winner", "casino", "bonus"]


def words(rng, n, extra=(), every=6):
    return " ".join(rng.choice(extra) if extra and i % every == 0 else rng.choice(WORDS) for i in range(n))


def planted():
    """Documents (doc_id, text, lang, source, n_chars), labels, and which documents are toxic."""
    rng, texts, labels, toxic = random.Random(11), {}, [], set()
    for i in range(400):
        kind = i % 4
        texts[i] = words(rng, 60, VILE if kind == 0 else SPAM if kind == 1 else ())
        if kind == 0:
            toxic.add(i)
        if i < 300:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    clean = [i for i in texts if i % 4 > 1]
    for n, i in enumerate(clean[:12]):  # exact copies, some with other white space, one group of many
        for k in range(40 if n == 0 else 2):
            texts[1000 + 50 * n + k] = texts[i] if k % 2 else texts[i].replace(" ", " \n ", 3)
    for n, i in enumerate(clean[12:24]):  # chains of near copies: one word is other than in the text before
        w = texts[i].split()
        for k in range(3):
            w = [*w]
            w[(7 + 20 * k) % 60] = f"new{n}x{k}"
            texts[2000 + 10 * n + k] = " ".join(w)
    for n, i in enumerate(clean[24:36]):  # too different to be near copies: every sixth word changed
        texts[3000 + n] = " ".join(f"other{n}x{k}" if k % 6 == 0 else x for k, x in enumerate(texts[i].split()))
    texts |= {4000: "", 4001: None, 4002: " ", 4003: words(rng, 30_000)}
    docs = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t or "")) for i, t in texts.items()]
    return docs + [(5000, texts[clean[40]], None, None, None)], labels, toxic


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def keep_first(docs):
    least = {}
    for d, t in docs.items():
        same = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        least[same] = min(d, least.get(same, d))
    return set(least.values())


def keep_near(docs):
    ids, sets = sorted(docs), {d: shingles(t) for d, t in docs.items()}
    group = {d: d for d in ids}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d for d in ids if root(d) == d}


def copies(sources):
    """How often each document comes: steps of its source's Poisson distribution below its number."""
    rows = Counter(sources.values())
    weight = {s: math.sqrt(n) for s, n in rows.items()}
    out = {}
    for d, s in sources.items():
        rate = weight[s] / sum(weight.values()) * len(sources) / rows[s]
        u = (int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
        n, mass = 0, math.exp(-rate)
        total = mass
        while total < u:
            n += 1
            mass *= rate / n
            total += mass
        if n:
            out[d] = n
    return out


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels, toxic = planted()
    (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
     .write.parquet(f"{folder}/documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen, stored = {}, corpus_pipeline.stored
    with pytest.MonkeyPatch.context() as patch:
        def keep(df, name):
            seen[name] = stored(df, name)
            return seen[name]

        patch.setattr(corpus_pipeline, "stored", keep)
        corpus_pipeline.run(spark, folder)
    assert list(seen) == [name for name, _ in corpus_pipeline.STAGES]
    return {name: [r.asDict() for r in df.collect()] for name, df in seen.items()}, {d[0]: d for d in docs}, toxic


def texts_of(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_toxic_documents_go_and_clean_ones_stay(run):
    seen, docs, toxic = run
    assert set(texts_of(seen["toxicity"])) == set(docs) - toxic


def test_copies_and_near_copies(run):
    seen, docs, _ = run
    before = texts_of(seen["toxicity"])
    assert set(texts_of(seen["exact_dedup"])) == keep_first(before)
    assert set(texts_of(seen["ngram_join"])) == keep_near(texts_of(seen["exact_dedup"]))
    kept = set(texts_of(seen["ngram_join"]))
    assert not any(1000 <= d < 3000 for d in kept) and set(range(3000, 3012)) <= kept and 4003 in kept and 5000 not in kept


def test_rows_stay_as_they_are(run):
    seen, docs, _ = run
    for name in ("toxicity", "exact_dedup", "ngram_join", "mixing"):
        for r in seen[name]:
            assert tuple(r.values()) == docs[r["doc_id"]] and list(r) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing(run):
    seen, _, _ = run
    assert Counter(r["doc_id"] for r in seen["mixing"]) == copies({r["doc_id"]: r["source"] for r in seen["ngram_join"]})


def test_packing(run):
    from tokenizers import Tokenizer

    seen, _, _ = run
    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    want, at = Counter(), {}
    for r in seen["mixing"]:
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r["doc_id"], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    rows = seen["bin_packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 1
