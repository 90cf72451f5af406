"""Toxicity categories by a chain of linear classifiers.

Categories are predicted one after another. Each is a logistic regression over the words of
a text and the probabilities of all earlier categories. For training, those earlier
probabilities are out-of-fold: a row's come from models that didn't see it, so the later
model learns from inputs like the ones it will get.

Training uses a bounded sample and therefore runs in one place; every text of the corpus is
scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.llm.common import slices, stored

#: Labelled rows that training uses at most, by a hash of their identifiers.
TRAIN_ROWS = 10_000
#: Words of the vocabulary, and of how many training rows each at least.
WORDS, WORD_ROWS = 16_384, 4
FOLDS = 3
ITERATIONS = 40
PENALTY = 1e-3
#: Words count for a category if their shares in its two classes differ by so many standard errors.
LEAST_Z = 4.5
#: No category is given at a probability below this.
LEAST_P = 0.5
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»‚‘’–—"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each word of ``texts`` (no nulls), its number among the different words, and these.

    A word is what stands between ASCII white space, in lower case and without
    punctuation at its ends."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    rows = pc.list_parent_indices(lists).to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=_PUNCTUATION).dictionary_encode()
    return rows, plain.indices.to_numpy()[coded.indices.to_numpy()], plain.dictionary


def known_words(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different known words of each text, as numbers, one text after another; and how many each text has."""
    rows, number, different = words_of(texts)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    place = pc.fill_null(pc.index_in(different, value_set=vocabulary), -1).to_numpy().astype(np.int64)[number]
    both = np.unique(rows[place >= 0].astype(np.int64) * (len(vocabulary) + 1) + place[place >= 0])
    return both % (len(vocabulary) + 1), np.bincount(both // (len(vocabulary) + 1), minlength=len(texts))


class Bags:
    """Sets of word numbers as a sparse matrix of 0 and the words' weights."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, weight: np.ndarray):
        self.words, self.counts, self.weight = words, counts.astype(np.int64), weight
        self.row = np.repeat(np.arange(len(counts)), self.counts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=(w * self.weight)[self.words], minlength=len(self.counts))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.words, weights=r[self.row], minlength=len(self.weight)) * self.weight

    def telling(self, y: np.ndarray) -> Bags:
        """The same with weight 0 for words that don't tell the classes of ``y`` apart."""
        n1 = max(y.sum(), 1.0)
        n0 = max(len(y) - n1, 1.0)
        ones = np.bincount(self.words, weights=y[self.row], minlength=len(self.weight))
        every = np.bincount(self.words, minlength=len(self.weight))
        share = every / len(y)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        z = np.abs(ones / n1 - (every - ones) / n0) / error
        return Bags(self.words, self.counts, np.where(z >= LEAST_Z, self.weight, 0.0))

    def take(self, rows: np.ndarray) -> Bags:
        return Bags(self.words[rows[self.row]], self.counts[rows], self.weight)


def minimise(value, x: np.ndarray, iterations: int, memory: int = 8) -> np.ndarray:
    """Smallest point of a smooth function by limited-memory quasi-Newton steps; ``value`` gives it and its gradient."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = value(x)
    for _ in range(iterations):
        q, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q = q - a * y
        if steps:
            s, y = steps[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            q = q + s * (a - (y @ q) / (s @ y))
        slope = g @ q
        if slope >= -1e-12:
            break
        length = 1.0 if steps else min(1.0, 1 / np.linalg.norm(g))
        for _ in range(20):
            new = x + length * q
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, f, g = new, f_new, g_new
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Link:
    """One category: weights of words and of earlier probabilities, and a constant."""

    name: str
    words: np.ndarray
    earlier: np.ndarray
    constant: float
    threshold: float = 2.0

    def predict(self, bags: Bags, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(bags.dot(self.words) + earlier @ self.earlier + self.constant)


def fit_link(name: str, bags: Bags, earlier: np.ndarray, y: np.ndarray) -> Link:
    """A logistic regression. With rows of one class only, or none, it is that class's constant."""
    v, e, share = len(bags.weight), earlier.shape[1], float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Link(name, np.zeros(v), np.zeros(e), 40.0 if share else -40.0)

    bags = bags.telling(y)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, u, b = x[:v], x[v : v + e], x[-1]
        z = bags.dot(w) + earlier @ u + b
        r = (sigmoid(z) - y) / len(y)
        loss = float(np.mean(np.logaddexp(0, z) - y * z)) + PENALTY * float(x[:-1] @ x[:-1]) / 2
        g = np.concatenate([bags.back(r), earlier.T @ r, [r.sum()]])
        g[:-1] += PENALTY * x[:-1]
        return loss, g

    start = np.zeros(v + e + 1)
    start[-1] = np.log(share / (1 - share))
    x = minimise(value, start, ITERATIONS)
    return Link(name, x[:v], x[v : v + e], float(x[-1]))


def out_of_fold(name: str, bags: Bags, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Probability of every row by a link that was fitted without its fold; rows without label are NaN in ``y``."""
    out, labelled = np.zeros(len(y)), ~np.isnan(y)
    for k in np.unique(fold):
        seen, held = labelled & (fold != k), fold == k
        out[held] = fit_link(name, bags.take(seen), earlier[seen], y[seen]).predict(bags.take(held), earlier[held])
    return out


def fit_chain(names: list[str], bags: Bags, labels: list[np.ndarray], fold: np.ndarray) -> list[Link]:
    """The links in their order; each is trained with out-of-fold probabilities of the earlier ones."""
    links, earlier = [], np.zeros((len(fold), 0))
    for name, y in zip(names, labels):
        labelled = ~np.isnan(y)
        out = out_of_fold(name, bags, earlier, y, fold)
        link = fit_link(name, bags.take(labelled), earlier[labelled], y[labelled])
        links.append(Link(name, link.words, link.earlier, link.constant, best_threshold(out[labelled], y[labelled])))
        earlier = np.column_stack([earlier, out])
    return links


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next lower probability; without positive rows none is reached."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # A cut lies only between different probabilities.
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return max(float(p[order][k] + low) / 2, LEAST_P)


@dataclass(frozen=True)
class Chain:
    """Vocabulary, weights of its words, and the categories in their order."""

    vocabulary: list[str]
    weight: np.ndarray
    links: list[Link]

    def probabilities(self, texts: pa.Array, vocabulary: pa.Array) -> np.ndarray:
        """One row per text (no nulls), one column per category."""
        bags = Bags(*known_words(texts, vocabulary), self.weight)
        out = np.zeros((len(texts), 0))
        for link in self.links:
            out = np.column_stack([out, link.predict(bags, out)])
        return out

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``__p_<category>`` and ``__is_<category>``; all rows and columns stay."""
        names = [k.name for k in self.links]
        shared = docs.sparkSession.sparkContext.broadcast(self)  # bounded by the vocabulary
        schema = T.StructType([*docs.schema.fields, *[T.StructField(f"__p_{n}", T.DoubleType()) for n in names],
                               *[T.StructField(f"__is_{n}", T.BooleanType()) for n in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = shared.value
            vocabulary = pa.array(chain.vocabulary, pa.large_string())
            for b in batches:
                texts = pc.fill_null(b.column(text).cast(pa.large_string()), "")
                parts = [chain.probabilities(texts[i:j], vocabulary) for i, j in slices(texts)]
                p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
                flags = [p[:, k] >= link.threshold for k, link in enumerate(chain.links)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *[pa.array(p[:, k]) for k in range(len(names))], *[pa.array(x) for x in flags]],
                    names=[*b.schema.names, *[f"__p_{n}" for n in names], *[f"__is_{n}" for n in names]])

        return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, key: str = "doc_id", text: str = "text",
        train_rows: int = TRAIN_ROWS, folds: int = FOLDS) -> Chain:
    """Train a chain over ``categories`` (name to a 0/1 or NULL column of ``labels``), in their order.

    At most ``train_rows`` labelled rows are used: those with the smallest hashes of their
    identifiers, so the choice doesn't depend on order or size. Rows without identifier or
    without any label are left out; NULL texts are empty. Of documents that repeat an
    identifier one counts; of labels that disagree the larger, so 1 wins over 0.
    """
    names = list(categories)
    chosen = (labels.select(F.col(key).cast("long").alias("__key"), *[c.cast("double").alias(f"__y_{n}") for n, c in categories.items()])
              .filter(F.col("__key").isNotNull()).groupBy("__key").agg(*[F.max(f"__y_{n}").alias(f"__y_{n}") for n in names])
              .filter(F.coalesce(*[F.col(f"__y_{n}") for n in names]).isNotNull())
              .orderBy(F.xxhash64("__key"), "__key").limit(train_rows))
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    # Documents that repeat an identifier fold before the shuffle; then both sides are bounded by train_rows.
    rows = (rows.join(F.broadcast(stored(chosen, "labels")), "__key").groupBy("__key", *[f"__y_{n}" for n in names])
            .agg(F.min(F.struct(F.xxhash64("__text").alias("hash"), F.col("__text").alias("text"))).alias("__first")))
    rows = stored(rows.select("__key", *[f"__y_{n}" for n in names], F.col("__first.text").alias("__text")), "train")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0)):
                at, number, different = words_of(b.column(0)[i:j])
                both = np.unique(at.astype(np.int64) * max(1, len(different)) + number)
                counts = np.bincount(both % max(1, len(different)), minlength=len(different))
                yield pa.RecordBatch.from_arrays([different.cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    counted = (rows.select("__text").mapInArrow(split, "word string, n long").filter("word <> ''")
               .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= WORD_ROWS))
    top = counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    vocabulary = [r.word for r in top]
    n_rows = rows.count()
    # Rare words tell more than frequent ones.
    weight = np.log((n_rows + 1) / np.array([r.n for r in top], float)) if top else np.zeros(0)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for b in batches:
            for i, j in slices(b.column("__text")):
                own, counts = known_words(b.column("__text")[i:j], known)
                ends = np.cumsum(counts)
                blobs = [own[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, counts)]
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(blobs, pa.binary()), *[
                    part.column(f"__y_{n}") for n in names]], names=["__key", "bag", *[f"__y_{n}" for n in names]])

    made = rows.mapInArrow(bags, f"__key long, bag binary, {', '.join(f'__y_{n} double' for n in names)}").collect()
    made = sorted(made, key=lambda r: r["__key"])
    lists = [np.frombuffer(r.bag, "<i4") for r in made]
    every = Bags(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.array([len(x) for x in lists], np.int64), weight)
    fold = np.random.default_rng(7).permutation(len(made)) % folds
    labels = [np.array([np.nan if r[f"__y_{n}"] is None else r[f"__y_{n}"] for r in made], float) for n in names]
    links = fit_chain(names, every, labels, fold)
    return Chain(vocabulary, weight, links)


def corpus_chain(docs: DataFrame, labels: DataFrame, **options) -> Chain:
    """The chain over the columns of ``labels``: poor texts first, then toxic ones."""
    return fit(docs, labels, {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}, **options)


def categories(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``p_poor``, ``p_toxic``, ``is_poor``, ``is_toxic``.

    A NULL text is an empty one and gets the probability of no words. Rows with equal
    texts get equal values; NULL identifiers stay. Without labels, or with labels of one
    class only, a category gets that class's constant probability; without a positive label
    nobody is flagged. An empty table gives an empty table.
    """
    slim = docs.select("doc_id", "text")
    out = corpus_chain(slim, labels, **options).transform(slim)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("p_poor", "p_toxic", "is_poor", "is_toxic")])


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the chain doesn't call toxic."""
    chain = corpus_chain(docs.select("doc_id", "text"), labels, **options)
    return chain.transform(docs).filter(~F.col("__is_toxic")).select(*docs.columns)
