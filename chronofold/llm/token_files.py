"""Token-id files: Elias-Fano document boundaries over one concatenated id array.

A file is a run of segments. A segment holds the ids of consecutive documents (ascending doc_id):

    magic 8 bytes | part, number, n_docs, n_missing_ids, n_ids, width, boundary bytes, doc-id bytes (8 x int64)
    boundaries: Elias-Fano of the n_docs end positions
    doc ids:    Elias-Fano of doc_id minus the least, int64 least before it (rows without doc_id come first)
    ids:        n_ids little-endian unsigned integers of ``width`` bytes
    one byte 0x0A

Elias-Fano stores n values below u in about n * (2 + log2(u / n)) bits; a 32-bit select sample for every
64th value finds any offset without a table of 64-bit offsets. A file holds one segment (SEGMENT_IDS ids, or one document
that is longer), so files stay small whatever the corpus. Spark's own writer commits them (a
binary payload cast to string is written byte by byte by the text source), so a lost executor leaves no
half-written segment. Ids wider than ``width`` bytes are refused before anything is written.

Nulls: a missing text is the empty one, a missing doc_id sorts first and stays missing. Equal doc_ids keep
all their rows, in an order fixed by the text. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.encoding import encoder
from chronofold.llm.shared import new_path, stored, text_of

MAGIC = b"CFTOKEN1"
HEAD = struct.Struct("<8s8q")
EF_HEAD = struct.Struct("<3q")
END_ID = 2
#: A select sample for so many values.
SELECT_STEP = 64
#: Ids after which a segment is closed.
SEGMENT_IDS = 16_000_000
ROWS = 1024


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        width = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> width) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return EF_HEAD.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> EliasFano:
        n, low_bits, n_high = EF_HEAD.unpack_from(raw)
        n_low = (n * low_bits + 7) // 8
        at = EF_HEAD.size
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<u4", -(-n // SELECT_STEP), at + n_low + n_high))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, bytes of the upper bits are counted."""
        byte, left = int(self.sample[i // SELECT_STEP]), i % SELECT_STEP
        at, inside = byte >> 3, byte & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + 64], bitorder="little")[inside:]) + inside
            if left < len(ones):
                where = at * 8 + int(ones[left])
                return ((where - i) << self.low_bits) + int(self._low(np.array([i]))[0])
            left, at, inside = left - len(ones), at + 64, 0

    def all(self) -> np.ndarray:
        """All values."""
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = np.empty(self.n, np.int64)
        for a in range(0, self.n, 65536):
            out[a : a + 65536] = ((ones[a : a + 65536] - i[a : a + 65536]) << self.low_bits) + self._low(i[a : a + 65536])
        return out


def pack_segment(part: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One segment without its closing byte."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds, names = EliasFano.of(ends).to_bytes(), struct.pack("<q", least) + EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, part, number, len(ids), len(ids) - len(known), int(ends[-1]), width, len(bounds), len(names))
    return head + bounds + names + np.concatenate(ids).astype(f"<u{width}").tobytes()


class Segment:
    """A segment read from a file; starts and ids of any document without decoding the others."""

    def __init__(self, raw: memoryview, at: int = 0):
        magic, self.part, self.number, self.n_docs, self.n_missing, self.n_ids, self.width, n_bounds, n_names = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at += HEAD.size
        self.ends = EliasFano.from_bytes(raw[at : at + n_bounds])
        at += n_bounds
        self.least = struct.unpack_from("<q", raw, at)[0]
        self.names = EliasFano.from_bytes(raw[at + 8 : at + n_names])
        at += n_names
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at)
        self.end = at + self.n_ids * self.width + 1

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_missing + (self.names.all() + self.least).tolist()

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def segments(raw: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        seg = Segment(view, at)
        at = seg.end
        yield seg


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, spaces_count: bool, width: int = 2, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes docs (doc_id, text) and writes token files in ascending doc_id order.

    Ranges of doc_id are dealt by a sample of the ids, equal doc_ids by their texts' hash too, so a doc_id that holds
    many rows is spread; AQE joins small ranges. Memory of a task is one segment.
    """
    top = max(encoder(tokenizer_path, spaces_count).largest_id(), end_id)
    if top >= 1 << (8 * width):
        raise ValueError(f"ids up to {top} do not fit {width} bytes")
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number, names, ids, n = encoder(tokenizer_path, spaces_count), TaskContext.get().partitionId(), 0, [], [], 0
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                for doc_id, x in zip(some.column(0).to_pylist(), enc.encode_bytes(some.column(1).to_pylist())):
                    names.append(doc_id)
                    ids.append(np.frombuffer(x + last, "<u4").astype(f"<u{width}"))
                    n += len(ids[-1])
                    if n >= segment_ids:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([pack_segment(part, number, names, ids, width)], pa.binary())})
                        number, names, ids, n = number + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"value": pa.array([pack_segment(part, number, names, ids, width)], pa.binary())})

    rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Documents of the token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids).

    Files are read once; the segments' totals (one row for SEGMENT_IDS ids) are added up on the driver.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for s in segments(raw.as_buffer()):
                    ends = s.ends.all()
                    starts = np.concatenate([[0], ends[:-1]])
                    ids = s.ids.astype("<u4")
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, s.part, np.int64)), pa.array(np.full(n, s.number, np.int64)), pa.array(s.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        names=["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "part long, number long, doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = stored(files.mapInArrow(decode, schema), "token-rows")
    totals = sorted(map(tuple, rows.groupBy("part", "number").agg(F.sum("n_tokens")).collect()))
    bases, at = [], 0
    for part, number, n in totals:
        bases.append((part, number, at))
        at += n
    # One row for SEGMENT_IDS ids (or for a task): 100 TB of text make about two million rows, some 50 MB.
    base = spark.createDataFrame(bases, "part long, number long, base long")
    return rows.join(F.broadcast(base), ["part", "number"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(docs: DataFrame, tokenizer_path: str, spaces_count: bool = False, width: int = 2) -> DataFrame:
    """Writes docs as token files below the shared folder and returns what reading them back gives."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, spaces_count, width)
    return read_token_files(docs.sparkSession, path)
