"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is its target share of the output over its share of the
rows. Each document draws its number of copies from the Poisson distribution with that
mean, by inverting the distribution at a uniform number that a hash of seed and document
gives. The copies are shuffled by another hash. Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import hinted, stored

#: md5 digits that make a uniform number: 13 hexadecimal digits are 52 bits.
DIGITS = 13
SCALE = float(2**52)
#: Width of one row of the table of sources: the steps of its distribution.
STEP_BYTES = 16


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of ``parts``, joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(SCALE)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, *, column: str = "source",
          temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """Per source its rows, target share and repetition rate.

    ``weights`` are targets (any scale; a source that isn't named gets 0). Without them
    a source's target is its share of the rows to the power ``temperature``. The mix
    has ``size`` times the rows of ``docs`` on average.
    """
    counts = docs.groupBy(F.col(column).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("rows").cast("double"), F.lit(temperature)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
        weighed = counts.withColumn("w", w)
    total = weighed.agg(F.sum("rows").alias("all_rows"), F.sum("w").alias("all_w"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.lit(0.0))
    # The totals are one row.
    return (weighed.crossJoin(F.broadcast(total)).withColumn("share", share)
            .withColumn("rate", F.col("share") * F.col("all_rows") * F.lit(size) / F.col("rows"))
            .select("source", "rows", "share", "rate"))


def steps(rated: DataFrame) -> DataFrame:
    """``rated`` with ``cdf``: the chance of at most 0, 1, 2, … copies, up to where it rounds to one."""
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    # Sums of logarithms, because the terms themselves underflow for large rates.
    log_mass = F.when(F.col("rate") > 0, F.col("k") * F.log("rate") - F.col("rate") - F.col("log_k")) \
        .otherwise(F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.lit(-1e300)))
    by_k = rated.withColumn("k", F.explode(F.sequence(F.lit(0), most))).withColumn(
        "log_k", F.expr("sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)"))
    mass = by_k.withColumn("mass", F.exp(log_mass)).withColumn(
        "at_most", F.expr("sum(mass) OVER (PARTITION BY source ORDER BY k)"))
    return mass.groupBy("source", "rate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "at_most"))), lambda x: x.at_most).alias("cdf"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with further underscores in front while it is taken."""
    while name in taken:
        name = f"_{name}"
    return name


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, *, column: str = "source",
              key: str = "doc_id", temperature: float = 0.5, size: float = 1.0, seed: int = 7) -> DataFrame:
    """Copies of the rows of ``docs`` so that sources reach their weights, shuffled globally.

    Adds ``__copy`` (from 1) and ``__order``, the hash that orders the output: partitions
    get rows by it and are sorted by it. If ``docs`` has such columns, the added ones have
    more underscores. A NULL source is a source of its own; a NULL key
    counts as the text ``null``. Rows with the same key draw the same number. A document
    of rate r comes r times on average and may get no copy: that is the operator. Empty
    tables give empty tables.
    """
    table = stored(steps(rates(docs, weights, column=column, temperature=temperature, size=size))
                   .select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf")), "rates")
    widest = table.agg(F.max(F.size("__cdf"))).first()[0] or 1
    names = docs.columns
    copy, order = fresh(names, "__copy"), fresh(names, "__order")
    # The row as one value: its columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    name = F.coalesce(F.col("row")[key].cast("string"), F.lit("null"))
    # The number of steps that lie below the uniform number is the inverse.
    times = F.size(F.filter("__cdf", lambda step: step < F.col("u")))
    joined = rows.withColumn("u", uniform(F.lit(str(seed)), name)).join(
        hinted(table, widest * STEP_BYTES), F.col("row")[column].eqNullSafe(F.col("__source")), "left")
    spread = joined.withColumn("n", times).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias(copy))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), name, F.col(copy).cast("string")))
    return spread.withColumn(order, place).repartition(order).sortWithinPartitions(order).select("row.*", copy, order)


def sql(temperature: float = 0.5, seed: int = 7) -> str:
    """The same in DuckDB, for the query over ``documents``."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT *, pow(n::DOUBLE, {temperature}) AS w FROM counts),
rated AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(n) FROM weighed) * 1.0 / n AS rate FROM weighed),
by_k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rated),
logs AS (SELECT *, sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k) AS log_k FROM by_k),
mass AS (SELECT source, k, exp(k * ln(rate) - rate - log_k) AS mass FROM logs),
cdf AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS at_most FROM mass),
lists AS (SELECT source, list(at_most ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (SELECT d.*, coalesce(doc_id::VARCHAR, 'null') AS name FROM documents d),
numbers AS (SELECT *, (('0x' || substr(md5('{seed}:' || name), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {SCALE} AS u FROM drawn),
counted AS (SELECT d.*, len(list_filter(l.cdf, lambda x: x < d.u)) AS times
  FROM numbers d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
spread AS (SELECT doc_id, text, lang, source, n_chars, name, unnest(range(1, times + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy,
  md5('{seed}:order:' || name || ':' || copy) AS shuffle_key FROM spread"""
