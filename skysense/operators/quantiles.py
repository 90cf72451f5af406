"""Exact quantiles by radix selection, without holding a group's values in one task.

The first pass counts rows by the leading bits of their values, which order as the values
do: sign, exponent and 16 bits of the mantissa. Running counts per group tell which of
these buckets hold the wanted ranks. The second pass takes only the values in those
buckets, folds equal ones before it moves them, and counts on to the exact order
statistics. Groups of one row and of any number of rows go the same way; of a large group
only counters and about one in 100,000 values per wanted rank are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysense.operators.shapes import per_measure, to_long
from skysense.session import attach

ACCURACY = 10_000
#: Buckets between a power of two and the next one.
BUCKETS = 1 << 16


def leading_bits(value: Column) -> Column:
    """A number that never falls where ``value`` (a double) rises: its sign, exponent and leading mantissa bits."""
    size = F.abs(value)
    finite = size < float("inf")
    # The logarithm may be off by one beside a power of two; doubling and halving are exact.
    guess = F.greatest(F.least(F.floor(F.log2(F.when(finite & (size > 0), size))), F.lit(1023)), F.lit(-1022))
    scaled = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(scaled >= 2, 1).when((scaled < 1) & (guess > -1022), -1).otherwise(0)
    place = (exponent + 1022) * BUCKETS + F.floor(size * F.pow(F.lit(2.0), -exponent) * BUCKETS)
    bits = F.when(size == 0, 0).when(finite, place).otherwise(F.when(F.isnan(value), 2049).otherwise(2048) * BUCKETS)
    return F.when(value < 0, -bits).otherwise(bits).cast("long")


def quantiles(df: DataFrame, measures: Sequence[str], probs: Sequence[float],
              keys: tuple[str, ...] = (), *, accuracy: int | None = None, name: str = "measure", exact: bool = True) -> DataFrame:
    """``(keys, name, n, q)``: ``q`` holds the interpolated quantile of each prob.

    Same definition as linear interpolation between order statistics at rank
    ``p * (n - 1)``. Measures without any value in a group have no row.
    With ``exact=False`` one pass returns actual values whose rank is off by at most
    ``n / accuracy``.
    """
    if not exact:
        return _sketched(df, measures, probs, keys, accuracy or ACCURACY, name)
    by = (*keys, name)
    values = to_long(df, measures, keys, name=name).filter(F.col("value").isNotNull()).withColumn("_bits", leading_bits(F.col("value")))
    group = Window.partitionBy(*by)
    rank = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ends = [e for r in rank for e in (F.floor(r), F.ceil(r))]

    def holds(r: Column) -> Column:
        return (F.col("_from") <= r) & (r < F.col("_to"))

    counters = values.groupBy(*by, "_bits").agg(F.count(F.lit(1)).alias("rows"))
    placed = counters.select(*by, "_bits", F.sum("rows").over(group).alias("n"), "rows", F.sum("rows").over(
        group.orderBy("_bits").rowsBetween(Window.unboundedPreceding, 0)).alias("_to")).withColumn("_from", F.col("_to") - F.col("rows"))
    chosen = placed.filter(reduce(lambda a, b: a | b, [holds(r) for r in ends])).select(*by, "_bits", "n", F.col("_from").alias("_below"))
    # Rows of other buckets have no partner and go.
    inside = attach(values, chosen, (*by, "_bits")).filter(F.col("n").isNotNull())
    counted = inside.groupBy(*by, "_bits", "n", "_below", "value").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by, "_bits").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_to", F.col("_below") + upto).withColumn("_from", F.col("_to") - F.col("rows"))
    picked = ranked.groupBy(*by, "n").agg(*[F.max(F.when(holds(r), F.col("value"))).alias(f"_{i}") for i, r in enumerate(ends)])

    def interpolate(i: int) -> Column:
        lo, hi = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        return lo + (hi - lo) * (rank[i] - F.floor(rank[i]))

    return picked.select(*by, "n", F.array(*[interpolate(i) for i in range(len(probs))]).alias("q"))


def quantiles_wide(df: DataFrame, measures: Sequence[str], probs: Sequence[float],
                   keys: tuple[str, ...] = (), *, exact: bool = True) -> DataFrame:
    """One row per key with an array column ``_q_{measure}`` per measure."""
    long = quantiles(df, measures, probs, keys, exact=exact)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(f"_q_{m}") for m in measures])


def _sketched(df: DataFrame, measures: Sequence[str], probs: Sequence[float], keys: tuple[str, ...],
              accuracy: int, name: str) -> DataFrame:
    at = F.array(*[F.lit(float(p)) for p in probs])
    found = per_measure(df, keys, measures, lambda m: {
        "n": F.count(m), "q": F.percentile_approx(F.col(m).cast("double"), at, F.lit(accuracy))}, name=name)
    return found.filter(F.col("n") > 0)
