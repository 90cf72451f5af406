"""How rows form ordered series, and how to compute along them at any size.

A window over a whole series puts that series into one task. Nothing here does
that. A series is cut into pieces instead, in one of two ways:

* time chunks: rows of one series and one stretch of time. Facts that cross a
  chunk border (row counts, last and first valid value) travel through a summary
  with one row per chunk, which is joined back.
* row blocks: exactly ``block`` consecutive rows by position, plus a halo of rows
  copied from the neighbouring blocks for lags, leads and rolling frames.

A time chunk holds at most as many rows as there are distinct times in it if rows
are unique per time (after ``dedupe_first`` or an aggregation). Where they are not,
``Series(chunk=None)`` cuts by number of rows instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.functions.timeaxis import micros, seconds
from skysense.session import materialize

CHUNK = "_chunk"
BLOCK = "_block"
POSITION = "_pos"
WEEK = 7 * 24 * 3600


@dataclass(frozen=True)
class Series:
    """Which columns identify a series and order its rows.

    ``chunk`` is a length in seconds, or in units of ``ts`` if that is a number.
    Choose it so that a chunk has some thousand rows. With None the rows are range
    partitioned in order and stored first, which gives chunks of equal size even if
    many rows share one time. A NULL key or time raises an error when rows are ordered:
    such rows have no place in a series (``filter_valid_ts`` drops those without time).
    ``tiebreak`` must make the order total where times repeat.
    """

    keys: tuple[str, ...] = ("station",)
    ts: str = "datetime"
    tiebreak: tuple[str, ...] = ()
    chunk: int | None = WEEK
    block: int = 4096

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.tiebreak)

    def within(self, *more: str) -> Series:
        """The same order with additional key columns."""
        return replace(self, keys=(*self.keys, *more))

    def over_all(self) -> Series:
        """All rows as one series; the keys become tiebreaks."""
        return replace(self, keys=(), tiebreak=(*self.tiebreak, *self.keys))

    def is_numeric(self, df: DataFrame) -> bool:
        return isinstance(df.schema[self.ts].dataType, T.NumericType)

    def axis(self, df: DataFrame) -> Column:
        """Exact integer coordinate of a row on the time axis."""
        return F.col(self.ts).cast("long") if self.is_numeric(df) else micros(df, self.ts)

    def checked(self, place: Column) -> Column:
        """``place``, or an error for rows that have none."""
        gone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*self.keys, self.ts)])
        text = f"a row has no value in {', '.join((*self.keys, self.ts))}, so it has no place in a series"
        return F.when(gone, F.raise_error(F.lit(text)).cast("long")).otherwise(place)

    def with_chunk(self, df: DataFrame) -> DataFrame:
        if self.chunk is None:
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ranged = df.repartitionByRange(n, *self.keys, *self.order)
            # Stored, because the ids must be the same wherever they are used.
            return materialize(ranged.withColumn(CHUNK, self.checked(F.spark_partition_id().cast("long"))))
        unit = F.col(self.ts) if self.is_numeric(df) else seconds(self.ts)
        return df.withColumn(CHUNK, self.checked(F.floor(unit / F.lit(self.chunk)).cast("long")))

    def chunk_window(self, descending: bool = False):
        cols = [F.desc(c) if descending else F.asc(c) for c in self.order]
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*cols)

    def summary_window(self, descending: bool = False):
        """Over the one-row-per-chunk summary of a series, excluding the current chunk."""
        chunk = F.desc(CHUNK) if descending else F.asc(CHUNK)
        return (Window.partitionBy(*self.keys).orderBy(chunk)
                .rowsBetween(Window.unboundedPreceding, -1))


def number_rows(df: DataFrame, s: Series, position: str = POSITION, total: str | None = None) -> DataFrame:
    """0-based ``position`` of every row in its series, and optionally the series length."""
    chunked = s.with_chunk(df)
    counts = chunked.groupBy(*s.keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(s.summary_window()), F.lit(0)).alias("_offset")
    cols = [*s.keys, CHUNK, offset]
    if total:
        cols.append(F.sum("_rows").over(Window.partitionBy(*s.keys)).alias(total))
    local = chunked.withColumn("_rn", F.row_number().over(s.chunk_window()))
    return (local.join(counts.select(*cols), [*s.keys, CHUNK], "left")
            .withColumn(position, F.col("_offset") + F.col("_rn") - 1)
            .drop(CHUNK, "_rn", "_offset"))


def grid_position(df: DataFrame, s: Series, step: int, position: str = POSITION) -> DataFrame:
    """Position by arithmetic, for series that have a row at every ``step`` seconds."""
    return df.withColumn(position, s.checked(F.floor(seconds(s.ts) / F.lit(step)).cast("long")))


def along_rows(df: DataFrame, s: Series, exprs, *, before: int = 0, after: int = 0,
               step: int | None = None) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``exprs(window)`` returns the columns to add; ``window`` is ordered by row
    position. With ``step`` the rows are known to form a gapless grid and the
    position needs no ranking pass.
    """
    block = max(s.block, before, after)
    numbered = grid_position(df, s, step) if step else number_rows(df, s)
    home = F.floor(F.col(POSITION) / F.lit(block)).cast("long")
    at = F.pmod(F.col(POSITION), F.lit(block))
    # A row near the end of its block is also needed by the next one, and a row near
    # the start by the one before.
    first = home - (at < after).cast("long") if after else home
    last = home + (at >= block - before).cast("long") if before else home
    spread = numbered.withColumn("_home", home).withColumn(BLOCK, F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*s.keys, BLOCK).orderBy(POSITION)
    return (spread.select("*", *exprs(window))
            .filter(F.col(BLOCK) == F.col("_home"))
            .drop(BLOCK, "_home", POSITION))


def neighbours(df: DataFrame, s: Series, measures: Sequence[str], *, by: str = "time",
               sides: Iterable[str] = ("prev", "next")) -> DataFrame:
    """Nearest valid points around every row.

    Adds ``_x`` (coordinate of the row) and, per measure and side,
    ``_{side}_{measure}``: a struct ``(x, v)`` of the nearest row at or before
    (``prev``) or at or after (``next``) with a value, NULL if there is none.
    ``by`` is ``"time"`` (``x`` in microseconds) or ``"row"`` (``x`` the position).
    """
    sides = tuple(sides)
    chunked = s.with_chunk(df)
    if by == "time":
        located = chunked.withColumn("_x", s.axis(df))
    else:
        located = chunked.withColumn("_x", F.row_number().over(s.chunk_window()).cast("long"))

    def point(m: str) -> Column:
        return F.expr(f"CASE WHEN `{m}` IS NOT NULL THEN struct(_x AS x, CAST(`{m}` AS DOUBLE) AS v) END")

    def edge(m: str, side: str) -> Column:
        # Orderings that are NULL, from rows without a value, are skipped. With plain
        # numbers as buffers this runs as a hash aggregation; only repeated times
        # need the whole order as a struct.
        ends, pick = ("max", "max_by") if side == "prev" else ("min", "min_by")
        x, v = f"CASE WHEN `{m}` IS NOT NULL THEN _x END", f"CAST(`{m}` AS DOUBLE)"
        if by == "time" and s.tiebreak:
            order = f"CASE WHEN `{m}` IS NOT NULL THEN struct({', '.join(f'`{c}`' for c in s.order)}) END"
            return F.expr(f"struct({pick}(_x, {order}) AS x, {pick}({v}, {order}) AS v)").alias(f"_edge_{side}_{m}")
        return F.expr(f"struct({ends}({x}) AS x, {pick}({v}, {x}) AS v)").alias(f"_edge_{side}_{m}")

    summary = located.groupBy(*s.keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"), *[edge(m, side) for m in measures for side in sides])
    offset = F.lit(0) if by == "time" else F.coalesce(F.sum("_rows").over(s.summary_window()), F.lit(0))
    summary = summary.withColumn("_offset", offset.cast("long"))

    def shifted(col: str) -> str:
        return f"CASE WHEN `{col}`.x IS NOT NULL THEN struct(`{col}`.x + _offset AS x, `{col}`.v AS v) END"

    carrying = {side: s.summary_window(descending=side == "next") for side in sides}

    def carried(m: str, side: str) -> Column:
        w = carrying[side]
        return F.last(F.expr(shifted(f"_edge_{side}_{m}")), ignorenulls=True).over(w).alias(f"_carry_{side}_{m}")

    carry = summary.select(*s.keys, CHUNK, "_offset", *[carried(m, side) for m in measures for side in sides])

    # "next" is a running last over the reversed order: a frame that ends at
    # unboundedFollowing would be evaluated anew for every row.
    running = {side: s.chunk_window(descending=side == "next").rowsBetween(Window.unboundedPreceding, 0)
               for side in sides}

    def near(m: str, side: str) -> Column:
        w = running[side]
        return F.last(point(m), ignorenulls=True).over(w).alias(f"_near_{side}_{m}")

    local = located.select("*", *[near(m, side) for side in sides for m in measures])
    joined = local.join(carry, [*s.keys, CHUNK], "left")
    found = [F.expr(f"coalesce({shifted(f'_near_{side}_{m}')}, `_carry_{side}_{m}`)").alias(f"_{side}_{m}")
             for m in measures for side in sides]
    return joined.select(*df.columns, (F.col("_x") + F.col("_offset")).alias("_x"), *found)
