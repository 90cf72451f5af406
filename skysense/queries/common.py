"""Registry of queries and the building blocks of their reference SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.series import Series
from skysense.session import materialize
from skysense.sources import readings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOURS = Series(keys=("station",), ts="datetime")
# A year per chunk: daily rows are sparse in time.
DAYS = Series(keys=("station",), ts="datetime", chunk=365 * 24 * 3600)
MS = readings.HOURLY
DS = readings.DAILY
DIGITS = 6
# Interpolated values often end in an exact half of the last digit kept. The nudge is
# far above floating-point noise and below that digit, so halves always round up.
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    """Register a query; its result is brought to plain types and rounded."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(spark, folder))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers as BIGINT, times as TIMESTAMP_NTZ."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + NUDGE, DIGITS)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly readings, stored: they are far smaller than the events and read several times."""
    return materialize(readings.hourly(spark, folder))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(readings.daily(spark, folder))


# ---- SQL ----

def r(expr: str, name: str | None = None) -> str:
    """Rounded output column; adding 0 turns a negative zero into zero."""
    return f"{rr(expr)} AS {name or expr}"


def rr(expr: str) -> str:
    return f"round({expr} + {NUDGE}, {DIGITS}) + 0.0"


def rounded(names: Sequence[str]) -> str:
    return ", ".join(r(n) for n in names)


HOURLY_SQL = """hourly AS (
  SELECT user_id % 4 AS station, date_trunc('hour', ts) AS datetime,
    round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS pm2_5,
    round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS pm10,
    round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS no2,
    round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS so2,
    round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS co
  FROM events GROUP BY 1, 2)"""

DAILY_SQL = """daily AS (
  SELECT l_suppkey AS station, l_shipdate AS datetime,
    round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 6) AS price,
    round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax
  FROM lineitem GROUP BY 1, 2)"""


def each(template: str, measures: Sequence[str] = MS, sep: str = ", ") -> str:
    """``template`` once per measure, with ``{m}`` replaced."""
    return sep.join(template.replace("{m}", m) for m in measures)


def long_sql(src: str = "hourly", measures: Sequence[str] = MS, name: str = "long", keep: str = "station, datetime") -> str:
    return f"{name} AS (" + each(f"SELECT {keep}, '{{m}}' AS measure, {{m}} AS value FROM {src}", measures, " UNION ALL ") + ")"


def interp_sql(src: str, out: str, *, measures: Sequence[str] = MS, by: str = "time", leading: bool = True,
               part: str = "station", order: str = "datetime") -> str:
    """CTEs that fill ``measures`` of ``src`` along ``order`` into ``out``."""
    x = "epoch_us(datetime)" if by == "time" else f"row_number() OVER (PARTITION BY {part} ORDER BY {order})"
    w = f"PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    f = f"PARTITION BY {part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    near = each(
        f"last_value({{m}} IGNORE NULLS) OVER ({w}) AS pv_{{m}}, "
        f"last_value(CASE WHEN {{m}} IS NOT NULL THEN x END IGNORE NULLS) OVER ({w}) AS px_{{m}}, "
        f"first_value({{m}} IGNORE NULLS) OVER ({f}) AS nv_{{m}}, "
        f"first_value(CASE WHEN {{m}} IS NOT NULL THEN x END IGNORE NULLS) OVER ({f}) AS nx_{{m}}", measures)
    lead = "nv_{m}" if leading else "NULL"
    value = each(
        f"CASE WHEN {{m}} IS NOT NULL THEN {{m}} WHEN pv_{{m}} IS NULL THEN {lead} WHEN nv_{{m}} IS NULL THEN pv_{{m}} "
        "ELSE pv_{m} + (nv_{m} - pv_{m}) * ((x - px_{m})::DOUBLE / (nx_{m} - px_{m})::DOUBLE) END AS {m}", measures)
    return (f"{out}_x AS (SELECT *, {x} AS x FROM {src}), "
            f"{out}_n AS (SELECT *, {near} FROM {out}_x), "
            f"{out} AS (SELECT * REPLACE ({value}) FROM {out}_n)")


def grid_sql(src: str, out: str, step: str = "INTERVAL 1 HOUR", measures: Sequence[str] = MS) -> str:
    return (f"{out}_b AS (SELECT station, min(datetime) AS lo, max(datetime) AS hi FROM {src} GROUP BY 1), "
            f"{out}_s AS (SELECT station, unnest(generate_series(lo, hi, {step})) AS datetime FROM {out}_b), "
            f"{out} AS (SELECT s.station, s.datetime, {each('h.{m}', measures)} FROM {out}_s s "
            f"LEFT JOIN {src} h ON h.station = s.station AND h.datetime = s.datetime)")


def cap_sql(src: str, out: str, measures: Sequence[str] = MS, k: float = 3.0, part: str = "station") -> str:
    """CTEs that cap ``measures`` of ``src`` at ``k`` quartile ranges per ``part``."""
    q = each("quantile_cont({m}, 0.25) AS a_{m}, quantile_cont({m}, 0.75) AS b_{m}", measures)
    low, high = f"(a_{{m}} - {k} * (b_{{m}} - a_{{m}}))", f"(b_{{m}} + {k} * (b_{{m}} - a_{{m}}))"
    value = each(f"CASE WHEN {{m}} < {low} THEN {low} WHEN {{m}} > {high} THEN {high} ELSE {{m}} END AS {{m}}", measures)
    return (f"{out}_q AS (SELECT {part}, {q} FROM {src} GROUP BY {part}), "
            f"{out} AS (SELECT s.* REPLACE ({value}) FROM {src} s JOIN {out}_q USING ({part}))")


# Persistence predictions over the filled hourly series.
FILLED_SQL = f"{HOURLY_SQL}, {interp_sql('hourly', 'filled')}"
PREDICTIONS_SQL = f"""{FILLED_SQL}, lagged AS (
  SELECT station, datetime, {each("{m}, lag({m}) OVER (PARTITION BY station ORDER BY datetime) AS p_{m}")} FROM filled),
predictions AS ({each("SELECT station, datetime, '{m}' AS measure, {m} AS actual, p_{m} AS predicted FROM lagged WHERE {m} IS NOT NULL AND p_{m} IS NOT NULL", MS, " UNION ALL ")})"""
