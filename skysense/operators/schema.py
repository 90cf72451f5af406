"""Finding, naming, parsing and validating columns of unfamiliar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.constants import (
    DATETIME_FORMATS, DATETIME_MIN_SHARE, DATETIME_NAME_PARTS, MEASURES, MIN_UPLOAD_ROWS,
)
from skysense.functions.numeric import share_pct
from skysense.sources.readings import count_problems


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def column_named_like_time(columns: Sequence[str], parts: Sequence[str] = DATETIME_NAME_PARTS) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def as_iso(c: Column) -> Column:
    """ISO-8601 text (or any time type) as TIMESTAMP_NTZ; NULL if it is none."""
    return c.try_cast("timestamp_ntz")


def detect_datetime_col(df: DataFrame, parts: Sequence[str] = DATETIME_NAME_PARTS) -> DataFrame:
    """One row (column, rule, parsed_share): the time column found by name, else the
    first column if more than 80 % of its values are times. No match: column NULL."""
    named = column_named_like_time(df.columns, parts)
    name = named or df.columns[0]
    share = F.avg(as_iso(_quoted(name).cast("string")).isNotNull().cast("int"))
    found = df.agg(share.alias("parsed_share"))
    if named:
        column, rule = F.lit(name), F.lit("name")
    else:
        ok = F.col("parsed_share") > DATETIME_MIN_SHARE
        column, rule = F.when(ok, F.lit(name)), F.when(ok, F.lit("content")).otherwise(F.lit("none"))
    return found.select(column.alias("column"), rule.alias("rule"), "parsed_share")


def _tries(raw: Column, formats: Sequence[str]) -> list[Column]:
    return [as_iso(raw), *[F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in formats]]


def readable_format(df: DataFrame, column: str, formats: Sequence[str] = DATETIME_FORMATS) -> int | None:
    """Which format reads every value there is (0 is ISO-8601, then ``formats``), if one does. One aggregation."""
    raw = _quoted(column).cast("string")
    counts = df.agg(F.count(raw).alias("n"), *[F.count(t).alias(f"_{i}") for i, t in enumerate(_tries(raw, formats))]).first()
    return next((i for i in range(len(formats) + 1) if counts[f"_{i}"] == counts.n), None)


def parse_with(df: DataFrame, column: str, which: int, out: str = "datetime",
               formats: Sequence[str] = DATETIME_FORMATS) -> DataFrame:
    parsed = _tries(_quoted(column).cast("string"), formats)[which]
    return df.select(*[_quoted(c) for c in df.columns if c != out], parsed.alias(out))


def parse_datetime(df: DataFrame, column: str, out: str = "datetime",
                   formats: Sequence[str] = DATETIME_FORMATS, *, strict: bool = False) -> DataFrame:
    """Parse text times by the first format that reads more than 80 % of the rows.

    ISO-8601 is tried first, then ``formats`` in order. All success shares come from
    one aggregate row, which is broadcast; values the chosen format cannot read
    become NULL. If no format is good enough, all of them do, or with ``strict`` the
    query fails.
    """
    raw = _quoted(column).cast("string")
    tries = _tries(raw, formats)
    shares = df.agg(*[F.avg(t.isNotNull().cast("int")).alias(f"_share{i}") for i, t in enumerate(tries)])
    choice = None
    for i, t in enumerate(tries):
        good = F.col(f"_share{i}") > DATETIME_MIN_SHARE
        choice = F.when(good, t) if choice is None else choice.when(good, t)
    if strict:
        choice = choice.otherwise(F.raise_error(F.lit(f"no known time format reads column {column}")).cast("timestamp_ntz"))
    joined = df.crossJoin(F.broadcast(shares))
    return joined.select(*[_quoted(c) for c in df.columns if c != out], choice.alias(out))


def measure_of(name: str) -> str | None:
    """The measure that a header such as ``PM 2.5`` or ``Carbon Monoxide`` names."""
    plain = "".join(ch for ch in name.lower() if ch not in " _.")
    parts = {"pm25": "pm2_5", "pm10": "pm10", "no2": "no2", "so2": "so2"}
    for part, measure in parts.items():
        if part in plain:
            return measure
    if plain in ("co", "carbonmonoxide"):
        return "co"
    return "o3" if "o3" in plain or "ozone" in plain else None


def map_measure_cols(df: DataFrame) -> DataFrame:
    """Rename measure columns to their internal names, in place.

    If several columns name one measure, the first value present in column order is
    taken, since one table cannot hold two columns of the same name.
    """
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        m = measure_of(c)
        if m:
            sources.setdefault(m, []).append(c)
    out = []
    for c in df.columns:
        m = measure_of(c)
        if m is None:
            out.append(_quoted(c))
        elif sources[m][0] == c:
            out.append(F.coalesce(*[_quoted(x) for x in sources[m]]).alias(m))
    return df.select(*out)


def validate_upload(df: DataFrame, measures: Sequence[str] = MEASURES, min_rows: int = MIN_UPLOAD_ROWS, *,
                    problems: str | None = None) -> DataFrame:
    """One row (rule, ok, detail) per rule; an empty table is checked for nothing else.

    ``problems`` names the column of a checked scan that lists what couldn't be read; lines
    and the cells of each column are then rules of their own, counted in the same pass.
    """
    present = [m for m in measures if m in df.columns]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    checks = [("has_datetime", column_named_like_time(df.columns, ("date", "time")) is not None,
               column_named_like_time(df.columns, ("date", "time")) or ""),
              ("has_measure", bool(present), ",".join(present)),
              *[(f"numeric_{m}", m in numeric, df.schema[m].dataType.simpleString()) for m in present]]
    bad = {"readable_lines": count_problems(problems, "line"),
           **{f"readable_{c}": count_problems(problems, "cell", c) for c in df.columns if c != problems}} if problems else {}
    n = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"_{i}") for i, c in enumerate(bad.values())])
    count = F.col("n").cast("string")

    def row(rule: str, ok: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), ok.alias("ok"), detail.alias("detail"))

    first = row("not_empty", F.col("n") > 0, count)
    more = [row("min_rows", F.col("n") >= min_rows, count),
            *[row(r, F.lit(ok), F.lit(d)) for r, ok, d in checks],
            *[row(r, F.col(f"_{i}") == 0, F.col(f"_{i}").cast("string")) for i, r in enumerate(bad)]]
    listed = F.when(F.col("n") > 0, F.array(first, *more)).otherwise(F.array(first))
    return n.select(F.inline(listed))


def model_compat(df: DataFrame, measures: Sequence[str], models: DataFrame, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """Per series and measure: is there data, and is there a model.

    ``models`` is the table (measure, has_model) of the model store, one row per measure.
    """
    from skysense.operators.shapes import per_measure

    data = per_measure(df, keys, measures, lambda m: {"values": F.count(m)})
    joined = data.join(F.broadcast(models.select("measure", "has_model")), "measure", "left")
    return joined.select(*keys, "measure", "values", (F.col("values") > 0).alias("has_data"),
                         F.coalesce("has_model", F.lit(False)).alias("has_model"))


def missing_share(columns: Sequence[str]) -> Column:
    """Missing cells in percent of all cells."""
    gone = sum((F.count_if(_quoted(c).isNull()) for c in columns[1:]), F.count_if(_quoted(columns[0]).isNull()))
    return share_pct(gone, F.count(F.lit(1)) * len(columns))
