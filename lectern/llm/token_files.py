"""Token-id files with Elias-Fano document boundaries (operator 7).

Documents go to shards by ascending doc_id; a shard is one file:

    magic, version, bytes of an id        16 bytes: b"LECTOKEN", 2 x uint32
    ids                                   all documents one after the other, little-endian
    boundaries                            Elias-Fano: n + 1 offsets into the ids, from 0 to their count
    doc_ids                               Elias-Fano: those that aren't null, less the smallest
    trailer                               6 x int64 and the magic again

An id takes 2 bytes where the vocabulary allows it. Elias-Fano keeps ``l`` low bits of each offset in a packed array
and the rest in a bit vector with a one for each offset; of every ``SAMPLE``-th one the position is kept (32 bits),
so the i-th offset is found by counting bits over less than ``SAMPLE`` ones: about 2 + log2(ids / documents) bits for
a document and no table of 64-bit offsets.

Texts are encoded first, where they are read, so only ids are shuffled. A task streams its shard: ids are written as they
come, and 16 bytes for each document of the shard stay in memory until its boundaries are packed. Files are written
under another name and moved, so a task that runs again, or twice, leaves the same shard. Reading goes through select:
``ROWS`` boundaries at a time, never all of a file's.

Ids are those of the library with ``add_special_tokens=False``: the string of an added token in a text is that token.

Defined cases: a null or empty text is the end id alone. Rows without doc_id come first; rows of one doc_id are
ordered by a hash of their text, and rows that are equal stay as many as they are. A very long text is one document, its
ids held by one task. An empty table gives no files and no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import mapped, shared_folder
from lectern.llm.tokens import Encoder, json_tokenizer, slices

MAGIC = b"LECTOKEN"
VERSION = 1
END_ID = 2
SAMPLE = 512
#: Rows that a read returns at once.
ROWS = 4096
VOCABULARY = "byte_bpe_50k.json"


@dataclass
class EliasFano:
    """A sequence of ascending numbers from 0 to ``top``: ``get`` is select, ``slice`` selects a stretch."""

    n: int
    top: int
    low_bits: int
    low: np.ndarray  # uint8, packed
    high: np.ndarray  # uint8: a zero for each step of the high part, a one for each number
    samples: np.ndarray  # uint32: where the ones 0, SAMPLE, 2 * SAMPLE, ... are

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Packed in stretches of ``ROWS`` numbers, so little memory is needed besides the numbers themselves."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 7) // 8, np.uint8)
        high = np.zeros(((top >> bits) + n + 7) // 8, np.uint8)
        samples = []
        for at in range(0, n, ROWS):  # a multiple of 8, so each stretch begins a byte of low
            part = np.asarray(values[at : at + ROWS], np.int64)
            if bits:
                packed = np.packbits(((part[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
                low[at * bits // 8 :][: len(packed)] = packed
            ones = (part >> bits) + np.arange(at, at + len(part))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            samples.append(ones[::SAMPLE].astype(np.uint32))
        return cls(n, top, bits, low, high, np.concatenate(samples) if samples else np.zeros(0, np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.top, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return b"".join((head.tobytes(), self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, bits, low, high, samples = np.frombuffer(data, "<i8", 6).tolist()
        return cls(n, top, bits, np.frombuffer(data, np.uint8, low, 48), np.frombuffer(data, np.uint8, high, 48 + low), np.frombuffer(data, "<u4", samples, 48 + low + high))

    def get(self, i: int) -> int:
        """The i-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """The numbers start to end - 1: the sampled one before the first leads to its byte, and bytes are counted from
        there until all are found. Only the bytes of these numbers are decoded."""
        start, end = max(0, start), min(end, self.n)
        if start >= end:
            return np.zeros(0, np.int64)
        known = start // SAMPLE
        at = int(self.samples[known])
        skip, byte = start - known * SAMPLE, at // 8
        # a later sample, if there is one, bounds the bytes that hold these numbers
        after = -(-(end - 1) // SAMPLE)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        part = self.high[byte:stop].copy()
        part[0] &= 0xFF << at % 8 & 0xFF  # ones before the sampled one don't count
        counts = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        first, last = int(np.searchsorted(counts, skip, "right")), int(np.searchsorted(counts, skip + end - start, "left"))
        before = int(counts[first - 1]) if first else 0
        ones = np.flatnonzero(np.unpackbits(part[first : last + 1], bitorder="little"))[skip - before :][: end - start] + 8 * (byte + first)
        out = (ones - np.arange(start, end)) << self.low_bits
        if self.low_bits:
            begin = start * self.low_bits
            piece = self.low[begin // 8 : (end * self.low_bits + 7) // 8]
            bits = np.unpackbits(piece, bitorder="little")[begin % 8 :][: (end - start) * self.low_bits].reshape(-1, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.int64) << k
        return out


def id_type(size: int) -> str:
    """numpy's type for ids of a vocabulary of ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def open_folder(folder: str):
    """(file system, path) of a folder: local, or any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


MANIFEST = "shard int, name string, n_docs long, n_ids long"


@dataclass
class Bounds:
    """Where each shard begins: (doc_id, tie), null ids first."""

    of_null: np.ndarray  # ties
    ids: np.ndarray
    ties: np.ndarray

    def __len__(self) -> int:
        return len(self.of_null) + len(self.ids)

    def shards(self, ids: pa.Array, ties: np.ndarray) -> np.ndarray:
        """The shard of each (doc_id, tie)."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros(len(ids), np.int64)
        out[null] = np.searchsorted(self.of_null, ties[null], "right")
        known, mine = ids.drop_null().to_numpy(), ties[~null]
        low, high = np.searchsorted(self.ids, known, "left"), np.searchsorted(self.ids, known, "right")
        for k in np.unique(low[high > low]).tolist():  # ids that a shard begins with: their rows may fill several
            same = (low == k) & (high > k)
            high[same] = k + np.searchsorted(self.ties[k : high[same][0]], mine[same], "right")
        out[~null] = len(self.of_null) + high
        return np.maximum(out - 1, 0)


#: Bytes of text that a shard has at most, and at least where there are fewer shards than shuffle partitions.
MOST_BYTES, LEAST_BYTES = 64 << 20, 1 << 20


def bounds_of(keys: DataFrame) -> Bounds:
    """keys: doc_id, tie, n_bytes of each document. One scan without tokens; a few numbers a shard come to the driver."""
    size = keys.agg(F.sum("n_bytes")).first()[0] or 0
    parallel = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-size // MOST_BYTES), min(parallel, -(-size // LEAST_BYTES)))
    dealt = keys.select("doc_id", "tie").repartitionByRange(n, "doc_id", "tie")
    firsts = sorted((r.k for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "tie")).alias("k")).collect()), key=lambda k: (k.doc_id is not None, k.doc_id or 0, k.tie))
    known = [k for k in firsts if k.doc_id is not None]
    return Bounds(*(np.array(x, np.int64) for x in ([k.tie for k in firsts if k.doc_id is None], [k.doc_id for k in known], [k.tie for k in known])))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer's file, once per worker process: what it remembers serves the tasks to come."""
    if path not in _encoders:
        _encoders[path] = Encoder(json_tokenizer(path))
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer_path: str, bounds: Bounds, end_id: int = END_ID) -> DataFrame:
    """shard, doc_id, tie, ids of each row of ``docs`` (doc_id, tie, text): the ids in ``id_type``, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        kind = width_of(encoder.tokenizer, end_id)
        for b in batches:
            shard = bounds.shards(b.column(0), b.column(1).to_numpy()).astype(np.int32)
            for at, n in slices(b.column(2)):
                ids, size = encoder.encode(b.column(2).slice(at, n))
                ends = np.cumsum(size + 1)
                with_end = np.empty(len(ids) + n, kind)
                inside = np.ones(len(with_end), bool)
                inside[ends - 1] = False
                with_end[inside], with_end[ends - 1] = ids, end_id
                edges = np.r_[0, ends].astype(np.int64) * with_end.itemsize
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(with_end)])
                yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + n]), b.column(0).slice(at, n), b.column(1).slice(at, n), column.cast(pa.binary())], ["shard", "doc_id", "tie", "ids"])

    return docs.select("doc_id", "tie", "text").transform(mapped, run, "shard int, doc_id long, tie long, ids binary")


def width_of(tokenizer, end_id: int) -> str:
    return id_type(max(tokenizer.get_vocab_size(), end_id + 1))


class Writer:
    """A shard's file, written as documents come."""

    def __init__(self, folder: str, shard: int, width: int):
        (self.system, self.path), self.shard, self.width = open_folder(folder), shard, width
        self.system.create_dir(self.path, recursive=True)
        self.temporary = f"{self.path}/.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.temporary)
        self.out.write(MAGIC + np.array([VERSION, width], "<u4").tobytes())
        self.counts: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls = self.n_ids = 0

    def add(self, doc_ids: pa.Array, ids: pa.Array) -> None:
        size = pc.binary_length(ids).to_numpy().astype(np.int64) // self.width
        for piece in ids:
            self.out.write(piece.as_buffer())
        self.n_ids += int(size.sum())
        self.counts.append(size)
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().to_numpy())

    def close(self) -> tuple[int, str, int, int]:
        """The boundaries and the trailer, and the file under its name; its row of ``MANIFEST``."""
        name, known = f"shard-{self.shard:06d}.ids", np.concatenate(self.doc_ids)
        offsets = EliasFano.of(np.r_[0, np.cumsum(np.concatenate(self.counts))]).to_bytes()
        low = int(known[0]) if len(known) else 0
        names = EliasFano.of(known - low).to_bytes()
        self.out.write(offsets + names)
        self.out.write(np.array([16 + self.n_ids * self.width, len(offsets), len(names), low, self.nulls, self.n_ids], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.system.move(self.temporary, f"{self.path}/{name}")
        return self.shard, name, sum(map(len, self.counts)), self.n_ids


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) to ``folder``; a row for each file (``MANIFEST``), lazily.

    Shards are told from the ids and ties of documents alone, so texts are encoded where they are read, once, and only
    token ids are dealt out."""
    width = int(width_of(json_tokenizer(tokenizer_path), end_id)[-1])
    text = F.col("text").cast("string")
    # the tie: rows without an id, or with a common one, fill several shards
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    bounds = bounds_of(rows.select("doc_id", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, found = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for s, e in zip(edges, edges[1:]) if len(shard) else ():
                if writer is None or writer.shard != shard[s]:
                    if writer:
                        found.append(writer.close())
                    writer = Writer(folder, int(shard[s]), width)
                writer.add(b.column(1).slice(s, e - s), b.column(2).slice(s, e - s))
        if writer:
            found.append(writer.close())
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    dealt = encoded(rows, tokenizer_path, bounds, end_id).repartitionById(max(1, len(bounds)), F.col("shard"))
    return dealt.sortWithinPartitions("shard", "doc_id", "tie", "ids").select("shard", "doc_id", "ids").transform(mapped, run, MANIFEST)


class Shard:
    """A shard's file: its offsets by select, ids of any document."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        begins, offsets, names, self.low, self.nulls, self.n_ids = np.frombuffer(self.bytes(size - 56, 48), "<i8").tolist()
        head = self.bytes(0, 16)
        if head[:8] != MAGIC or self.bytes(size - 8, 8) != MAGIC:
            raise ValueError("not a whole shard")
        self.kind = f"<u{np.frombuffer(head[8:], '<u4')[1]}"
        self.offsets = EliasFano.from_bytes(self.bytes(begins, offsets))
        self.names = EliasFano.from_bytes(self.bytes(begins + offsets, names))

    def bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def __len__(self) -> int:
        return self.offsets.n - 1

    def ids(self, start: int, end: int) -> np.ndarray:
        width = int(self.kind[-1])
        return np.frombuffer(self.bytes(16 + start * width, (end - start) * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.offsets.get(i), self.offsets.get(i + 1))

    def doc_ids(self, start: int, end: int) -> list[int | None]:
        """Of the documents start to end - 1; those without an id come first."""
        none = max(0, min(end, self.nulls) - start)
        return [None] * none + (self.names.slice(start - self.nulls, end - self.nulls) + self.low).tolist()


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. manifest: a few numbers for each file."""
    files, before = [], 0
    for m in sorted(manifest, key=lambda m: m.shard):
        files.append((m.shard, m.name, before))
        before += m.n_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{name}") as file:
                    shard = Shard(file)
                    for at in range(0, len(shard), ROWS):
                        e = shard.offsets.slice(at, at + ROWS + 1)
                        ids = shard.ids(int(e[0]), int(e[-1])).astype("<u4")
                        view = memoryview(ids).cast("B")
                        crc = [zlib.crc32(view[4 * s : 4 * t]) for s, t in zip((e[:-1] - e[0]).tolist(), (e[1:] - e[0]).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(at, at + len(e) - 1), pa.int64()), pa.array(e[:-1] + base), pa.array(np.diff(e)), pa.array(crc, pa.int64())], names)

    rows = spark.createDataFrame(files, "shard int, name string, base long").repartition(max(1, len(files)))
    return rows.select("name", "base").transform(mapped, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token-id files in ``folder`` (default: a new one in the shared checkpoint
    folder) and return doc_id, start, n_tokens, ids_crc32 of each document as read back from them."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer_path, end_id).collect())
