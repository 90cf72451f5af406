"""WARC archives and a globally ordered index of their captures.

Every task writes one archive. Of records with equal payloads one is a response and the
others are revisits that refer to it. Each archive is then read back record by record,
which gives one index run, sorted by URL key and time. The runs are merged outside memory:
tasks own ranges of the key space, seek to their range in every run, and merge the runs
with a loser tree. Where there are more runs than one merge may open, groups of runs are
merged to longer ones first.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.llm.common import FILE, ROW, located, new_folder, open_input, open_output, stored

#: Runs that one merge opens at most, entries between two marks of a run, keys that are
#: sampled to cut ranges, and entries of a range, about.
FAN_IN, MARK_EVERY, SAMPLE_KEYS, RANGE_ENTRIES = 128, 256, 20_000, 20_000
GZIP_LEVEL = 1
#: The table has no capture times: a page's is this, plus a second per identifier.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
LAST_SECOND = 10**9

Key = tuple[str, str, int, int]


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query, in lower case; safe for one line."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url.lower(), safe="/:?=&%,().~-_")
    if not host:
        return quote(url.lower(), safe="/:?=&%,().~-_")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return quote((key + (f"?{parts.query}" if parts.query else "")).lower(), safe="/:?=&%,().~-_")


def captured(page_id: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=max(0, min(page_id or 0, LAST_SECOND)))).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the head of the response only, with the payload's length."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured(page_id)}",
             f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]-_.' + chr(39))}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def members(uri: str, read: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a file, read as a stream."""
    with open_input(uri) as f:
        data, offset = f.read(read), 0
        while data:
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while True:
                used += len(data)
                parts.append(unpack.decompress(data))
                if unpack.eof:
                    break
                data = f.read(read)
                if not data:
                    raise ValueError(f"{uri} ends within a record")
            used -= len(unpack.unused_data)
            yield offset, used, b"".join(parts)
            offset += used
            data = unpack.unused_data or f.read(read)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP head and payload of a record."""
    top, rest = raw.split(b"\r\n\r\n", 1)
    first, *lines = top.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    head, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    return fields, head, payload


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def entry(offset: int, length: int, raw: bytes) -> dict:
    """The index entry of a record; a response's payload is checked against its digest."""
    fields, head, payload = parse(raw)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"key": url_key(fields["WARC-Target-URI"]), "time": fields["WARC-Date"], "page_id": page_of(fields["WARC-Record-ID"]),
            "type": fields["WARC-Type"], "bytes": size, "digest": digest,
            "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "offset": offset, "length": length}


def order(e: dict) -> Key:
    return e["key"], e["time"], -1 if e["page_id"] is None else e["page_id"], e["offset"]


class LoserTree:
    """Merges sorted iterators of (key, item). Inner nodes keep the losers of their matches."""

    def __init__(self, sources: list[Iterator[tuple[Key, str]]]):
        self.sources, self.n = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.n)
        winners = [-1] * self.n + list(range(self.n))
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.winner = winners[1] if self.n > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x[0], a) <= (y[0], b)

    def __iter__(self) -> Iterator[tuple[Key, str]]:
        while self.n and (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.n) // 2
            while node >= 1:
                if not self._wins(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def write_run(uri: str, entries: Iterator[tuple[Key, str]]) -> dict:
    """Write sorted entries, one line each, then every ``MARK_EVERY``-th key with its offset."""
    marks, offset, n = [], 0, 0
    with open_output(uri) as f:
        for key, line in entries:
            if n % MARK_EVERY == 0:
                marks.append([list(key), offset])
            raw = line.encode() + b"\n"
            f.write(raw)
            offset, n = offset + len(raw), n + 1
        f.write(json.dumps(marks).encode() + f"\n{offset:020d}".encode())
    return {"uri": uri, "n": n}


def read_marks(f) -> tuple[list, int]:
    size = f.size()
    f.seek(size - 20)
    end = int(f.read(20))
    f.seek(end)
    return json.loads(f.read(size - 21 - end)), end


def read_run(uri: str, low: Key | None = None, high: Key | None = None, read: int = 64 << 10) -> Iterator[tuple[Key, str]]:
    """Entries of a run with ``low`` <= key < ``high``, from the last mark before ``low`` on."""
    with open_input(uri) as f:
        marks, end = read_marks(f)
        at = max(0, bisect.bisect_left([tuple(k) for k, _ in marks], low) - 1) if low is not None and marks else 0
        position = marks[at][1] if marks else end
        f.seek(position)
        rest = b""
        while position < end:
            data = f.read(min(read, end - position))
            position += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                key = order(json.loads(line))
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, line.decode()


def write_archives(pages: DataFrame, folder: str, *, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """One archive per task; returns their names and numbers of records."""
    rows = located(pages.select(F.col(key).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"),
                                F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("__html")))
    rows = rows.withColumn("__digest", F.unhex(F.sha1("__html")))
    place = F.struct(F.coalesce(F.col("__id"), F.lit(-(2**63))).alias("order"), FILE, ROW, F.col("__id").alias("id"))
    last = rows.filter(F.octet_length("__html") >= least_bytes).groupBy("__digest").agg(F.max(place).alias("__last"))
    judged = rows.join(last, "__digest", "left").select(
        "__id", "__url", "__html", F.col("__last.id").alias("__refers"),
        F.coalesce((F.col(FILE) != F.col("__last")[FILE]) | (F.col(ROW) != F.col("__last")[ROW]), F.lit(False)).alias("__revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            columns = [b.column(c) for c in ("__id", "__url", "__html", "__refers", "__revisit")]
            for i in range(b.num_rows):
                out = out or open_output(uri)
                page, link, html, refers, revisit = (c[i].as_py() for c in columns)
                out.write(gzip.compress(record(page, link, html.encode(), refers, revisit), GZIP_LEVEL, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"uri": uri, "n": n}])

    return stored(judged.mapInArrow(write, "uri string, n long"), "archives")


def index_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read every archive back and write its entries as a sorted run."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column("uri").to_pylist():
                name = archive.rsplit("/", 1)[1]
                entries = [entry(*m) | {"archive": name} for m in members(archive)]
                lines = sorted((order(e), json.dumps(e)) for e in entries)
                yield pa.RecordBatch.from_pylist([write_run(f"{folder}/{uuid.uuid4().hex}.run", iter(lines))])

    return stored(archives.repartition(max(1, archives.count())).mapInArrow(index, "uri string, n long"), "runs")


def shorten(runs: DataFrame, folder: str, fan_in: int) -> DataFrame:
    """Merge groups of runs until at most ``fan_in`` are left."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uris in b.column("uris").to_pylist():
                merged = LoserTree([read_run(u) for u in uris])
                yield pa.RecordBatch.from_pylist([write_run(f"{folder}/{uuid.uuid4().hex}.run", iter(merged))])

    while (n := runs.count()) > fan_in:
        # One row per run; groups of about equal size.
        groups = runs.withColumn("g", F.expr(f"ntile({-(-n // fan_in)}) OVER (ORDER BY uri)"))
        lists = groups.groupBy("g").agg(F.sort_array(F.collect_list("uri")).alias("uris"))
        runs = stored(lists.select("uris").repartition(-(-n // fan_in)).mapInArrow(merge, "uri string, n long"), "runs")
    return runs


def borders(runs: DataFrame, ranges: int, sample: int = SAMPLE_KEYS) -> list[Key]:
    """Keys that cut the entries into about ``ranges`` equal parts, from at most ``sample`` marks."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                with open_input(uri) as f:
                    found = [json.dumps(k) for k, _ in read_marks(f)[0]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["key"])

    marks = runs.select("uri").repartition(max(1, runs.count())).mapInArrow(keys, "key string")
    found = sorted(tuple(json.loads(r.key)) for r in marks.orderBy(F.xxhash64("key")).limit(sample).collect())
    cuts = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []
    return sorted(set(cuts))


ROWS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, "
        "captured string, archive string, record_offset long, record_length long, capture_range int, capture_order long")


def merge_runs(runs: DataFrame, folder: str, *, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All entries; ``capture_range`` and ``capture_order`` give their global order by URL key and time."""
    spark = runs.sparkSession
    runs = shorten(runs, folder, fan_in)
    total = runs.agg(F.sum("n")).first()[0] or 0
    uris = [r.uri for r in runs.select("uri").orderBy("uri").collect()]  # at most fan_in
    cuts = borders(runs, max(1, -(-total // range_entries)))
    bounds = list(zip([None, *cuts], [*cuts, None]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                low, high = bounds[k]
                found: list[dict] = []
                for n, (_, line) in enumerate(LoserTree([read_run(u, low, high) for u in uris])):
                    e = json.loads(line)
                    found.append({
                        "page_id": e["page_id"], "payload_bytes": e["bytes"], "payload_digest": e["digest"], "record_type": e["type"],
                        "refers_to": e["refers_to"], "url_key": e["key"], "captured": e["time"], "archive": e["archive"],
                        "record_offset": e["offset"], "record_length": e["length"], "capture_range": k, "capture_order": n})
                    if len(found) == 5_000:
                        yield pa.RecordBatch.from_pylist(found, schema=kind)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kind)

    kind = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t])
                      for name, t in (c.strip().split() for c in ROWS.split(","))])
    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(merge, ROWS)


def captures(spark: SparkSession, pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html",
             least_bytes: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Write ``pages`` to archives, read them back and return the merged index, one row per page.

    Of records whose payloads have at least ``least_bytes`` bytes and are equal, the one
    with the largest identifier is the response (of repeated identifiers the last row),
    and the others revisit it. A NULL payload is empty, a NULL URL has the empty key, a
    NULL identifier counts as the smallest. Other columns take no part. An empty table
    gives an empty table.
    """
    folder = new_folder(spark, "warc")
    archives = write_archives(pages, folder, key=key, url=url, payload=payload, least_bytes=least_bytes)
    return merge_runs(index_runs(archives, folder), folder, fan_in=fan_in)


#: The base32 alphabet.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
c AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, h, last,
  list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)) AS digits
  FROM p JOIN g USING (h))
SELECT page_id, payload_bytes, array_to_string(digits, '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM c"""
