"""Token ids in binary files with a shared compression dictionary.

A zstandard dictionary is trained on serialised id arrays of a bounded sample. Every
document is compressed by itself with it, so that one short document can be read without
its neighbours. A file is

    "TOKZST01", item size (1 byte), SHA-256 of the dictionary (32 bytes),
    one zstandard frame per document, in ascending order of identifiers,
    index: offsets of the frames and of their end (8 bytes each), token counts (8 each),
           identifiers (8 each), one byte per identifier that is 1 where it is missing,
    number of documents (8 bytes), offset of the index (8 bytes), "TOKZST01"

with all numbers little-endian. Files are written under names of their own attempt; the
manifest, which Spark commits, tells which ones count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.llm.common import new_folder, open_input, open_output, slices, stored
from skysense.llm.encode import encoder

MAGIC = b"TOKZST01"
HEAD = len(MAGIC) + 1 + 32
TAIL = 16 + len(MAGIC)
LEVEL = 3
#: The dictionary's bytes, the documents it is trained on, and how many ids of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_IDS = 64 << 10, 1_000, 4_096

MANIFEST = "part long, uri string, dictionary string, n_docs long, n_tokens long, n_bytes long"


def item_type(path: str) -> str:
    """Two bytes for each id if the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(ids) < 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, path: str, kind: str, *, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from the documents with the smallest hashes of identifier and text."""
    import zstandard

    sample = docs.orderBy(F.xxhash64("__id", "__text"), "__id").limit(sample_docs)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("__text"), "")
            out = []
            for start, stop in slices(texts):
                flat, sizes = encoder(path).encode(texts[start:stop])
                ends = np.cumsum(sizes)
                out += [flat[e - n : e][:SAMPLE_IDS].astype(kind).tobytes() for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    # At most sample_docs arrays of SAMPLE_IDS ids.
    samples = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their own bytes serve
        return b"".join(samples)[:DICTIONARY_BYTES]


class Frames:
    """Compresses and decompresses single documents."""

    def __init__(self, dictionary: bytes):
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=data).compress
        self.decompress = zstandard.ZstdDecompressor(dict_data=data).decompress


class Shard:
    """One file, opened for reading; ``ids(i)`` reads only the i-th document."""

    def __init__(self, uri: str, dictionary: bytes | None = None):
        self.file = open_input(uri)
        size = self.file.size()
        head = self._at(0, HEAD)
        tail = self._at(size - TAIL, TAIL)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.kind, self.dictionary = f"<u{head[8]}", head[9:].hex()
        if dictionary is None:
            dictionary = read_dictionary(uri.rsplit("/", 1)[0], self.dictionary)
        self.frames = Frames(checked(dictionary, self.dictionary))
        n, index = struct.unpack("<QQ", tail[:16])
        raw = self._at(index, size - TAIL - index)
        self.offsets = np.frombuffer(raw, "<u8", n + 1)
        self.sizes = np.frombuffer(raw, "<u8", n, 8 * (n + 1)).astype(np.int64)
        self.names = np.frombuffer(raw, "<i8", n, 8 * (2 * n + 1))
        self.missing = np.frombuffer(raw, "u1", n, 8 * (3 * n + 1))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.frames.decompress(self._at(a, b - a)), self.kind)

    def all(self, read: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read in large pieces."""
        n, i = len(self.sizes), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + read, side="right")) - 1)
            base = int(self.offsets[i])
            raw = memoryview(self._at(base, int(self.offsets[j]) - base))
            for k in range(i, j):
                yield np.frombuffer(self.frames.decompress(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]), self.kind)
            i = j


def checked(dictionary: bytes, name: str) -> bytes:
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError("the dictionary isn't the one these files were written with")
    return dictionary


def read_dictionary(folder: str, name: str) -> bytes:
    with open_input(f"{folder}/{name}.dictionary") as f:
        return f.read()


def write(docs: DataFrame, path: str, folder: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every whole text, each followed by ``end_id``, and return the manifest.

    Documents are in ascending order of identifiers over all files, those without one
    first, and repeated identifiers in the order of their texts' hashes. A NULL text is
    empty and has the end id only. Other columns take no part. An empty table gives an
    empty manifest.
    """
    docs = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = item_type(path)
    dictionary = train_dictionary(docs, path, kind)
    name = hashlib.sha256(dictionary).hexdigest()
    with open_output(f"{folder}/{name}.dictionary") as f:
        f.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, frames, part = None, None, TaskContext.get().partitionId()
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok"
        offsets, sizes, names = [HEAD], [], []
        for b in batches:
            texts = pc.fill_null(b.column("__text"), "")
            names.append(b.column("__id"))
            for start, stop in slices(texts):
                if out is None:
                    out, frames = open_output(uri), Frames(dictionary)
                    out.write(MAGIC + bytes([int(kind[2])]) + bytes.fromhex(name))
                flat, counts = encoder(path).encode(texts[start:stop])
                flat, end = flat.astype(kind), np.array([end_id], kind).tobytes()
                at = 0
                for n in counts.tolist():
                    frame = frames.compress(flat[at : at + n].tobytes() + end)
                    out.write(frame)
                    offsets.append(offsets[-1] + len(frame))
                    sizes.append(n + 1)
                    at += n
        if out is None:
            return
        ids = pa.chunked_array(names).combine_chunks()
        index = (np.array(offsets, "<u8").tobytes() + np.array(sizes, "<u8").tobytes()
                 + pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes()
                 + pc.is_null(ids).to_numpy(zero_copy_only=False).astype("u1").tobytes())
        out.write(index + struct.pack("<QQ", len(sizes), offsets[-1]) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pylist([{
            "part": part, "uri": uri, "dictionary": name, "n_docs": len(sizes), "n_tokens": sum(sizes),
            "n_bytes": offsets[-1] + len(index) + TAIL}])

    ordered = docs.repartitionByRange("__id", F.xxhash64("__text")).sortWithinPartitions("__id", F.xxhash64("__text"))
    return stored(ordered.mapInArrow(shard, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""
    # One row per file.
    before = F.expr("coalesce(sum(n_tokens) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    files = manifest.select("uri", "dictionary", before.alias("before")).repartition(max(1, manifest.count()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Shard(r["uri"])
                crcs = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for x in s.all()), np.int64, len(s.sizes))
                starts = np.cumsum(s.sizes) - s.sizes + r["before"]
                for i in range(0, len(crcs), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.names[part], pa.int64(), mask=s.missing[part].astype(bool)), pa.array(starts[part]),
                         pa.array(s.sizes[part]), pa.array(crcs[part])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    return read(write(docs, path, new_folder(spark, "tokens"), end_id=end_id))
