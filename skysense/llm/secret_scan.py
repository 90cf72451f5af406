"""Secret scans over a ledger of contents.

Every version of every file is addressed by the SHA-256 of its bytes. The ledger holds one
row per content and version of the rules. A scan reads only contents that the ledger lacks
for the present rules, each once however many paths hold it, adds their findings (also
empty ones), and joins the ledger back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import FILE, ROW, located, new_folder, rows_at, stored

#: The kinds in their order, what each matches, and how long it must be.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
#: Without one of these (in lower case) a text holds no assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
# A match is a whole run, so its least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rules:
    """A set of rules. ``version`` must change with every change of what they find."""

    version: str = "1"

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All findings as (start, kind's place, kind, end), in order."""
        found = []
        lower = text.lower()
        if any(h in lower for h in ASSIGN_HINTS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)


LEDGER = ("blob binary, rules string, findings array<struct<kind: string, start: long, stop: long>>")


def scan_texts(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            texts = b.column("__text")
            # One text at a time: a text may be long.
            found = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in rules.spans(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("__blob"), pa.array([rules.version] * len(found), pa.string()), pa.array(found, kind)],
                names=["blob", "rules", "findings"])
    return run


def scan(versions: DataFrame, *, key: str = "doc_id", text: str = "text", rules: Rules = Rules(),
         ledger: str | None = None) -> DataFrame:
    """Per row of ``versions``: ``doc_id``, ``blob``, ``findings`` (kind, start, stop in code points, stop exclusive).

    ``ledger`` is a folder that lasts from scan to scan; without it the ledger is a new
    one. A NULL text is empty. Rows that repeat an identifier or a text each get their
    row; a NULL identifier stays NULL. Other columns take no part. Empty tables give
    empty tables.
    """
    spark = versions.sparkSession
    folder = ledger or new_folder(spark, "blobs")
    rows = located(versions.select(F.col(key).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")))
    blob = F.unhex(F.sha2("__text", 256)).alias("__blob")
    paths = stored(rows.select("__id", blob, FILE, ROW), "paths")
    first = paths.groupBy("__blob").agg(F.min(F.struct(FILE, ROW)).alias("at"))
    try:
        known = spark.read.schema(LEDGER).parquet(folder).filter(F.col("rules") == rules.version)
        first = first.join(known.select(F.col("blob").alias("__blob")), "__blob", "left_anti")
    except AnalysisException:  # the first scan with this ledger
        pass
    unseen = stored(first.select(F.col("at").getField(FILE).alias(FILE), F.col("at").getField(ROW).alias(ROW)), "unseen")
    rest = stored(paths.select(FILE, ROW).join(unseen, [FILE, ROW], "left_anti"), "seen")
    todo = rows_at(rows, unseen, rest).select(blob, "__text")
    todo.mapInArrow(scan_texts(rules), LEDGER).write.mode("append").parquet(folder)
    # A blob that two scans wrote at the same time has the same findings twice.
    found = (spark.read.schema(LEDGER).parquet(folder).filter(F.col("rules") == rules.version)
             .groupBy(F.col("blob").alias("__blob")).agg(F.first("findings").alias("findings")))
    # Stored, so that the join's hot contents can be split.
    return paths.join(stored(found, "findings"), "__blob", "left").select(
        F.col("__id").alias("doc_id"), F.lower(F.hex("__blob")).alias("blob"), "findings")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, all spans as text, and the hash of those of the base rules (here: of all)."""
    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def plain_findings(text: str | None) -> tuple[int, int, int, str, str]:
    """The digest columns of one text, by the rules as they are stated; for tests."""
    text = text or ""
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             lambda m: len(m[2]) >= 8),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
            ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(base) for m in p.finditer(text) if ok(m))
    spans = ",".join(f"{base[k][0]}:{s}:{e}" for s, k, e in found)
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, hashlib.sha256(spans.encode()).hexdigest(), spans)
