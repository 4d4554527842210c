"""Byte-level BPE encoding and decoding (operator 9).

Encoding runs the tokenizers library over Arrow batches with the ranks of a rank file; the ids are those of the
ranks' own encoder. Decoding maps each id back to its bytes through the reversed byte table and joins them, so
characters that are split over ids come out whole; bytes that aren't UTF-8 are replaced in ``decoded_text``.

Offsets: the bytes of a text's ids follow one another, and each byte belongs to the character whose first byte is the
last one before it; so a batch's bytes, counted by their leading ones, map every id to the characters from that of its
first byte to that of its last. Ids that split a character all have that character in their range.

Defined cases: a null or empty text has no ids and decodes to nothing. Rows keep their doc_id, null or repeated. A very
long text is encoded whole, as the only one of its slice; an empty table gives no rows; columns beside doc_id and text
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mapped
from lectern.llm.tokens import Encoder, Strings, byte_table, rank_tokenizer, read_ranks, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks that a worker remembers, and bytes of text at once: less than for files, as other stages hold memory, too.
REMEMBERED = 100_000
AT_ONCE = 1 << 20
_loaded: dict[str, tuple] = {}


def loaded(path: str) -> tuple:
    """(tokenizer, bytes of each id) of a rank file, once per worker process."""
    if path not in _loaded:
        tokenizer = rank_tokenizer(read_ranks(path), public_tokenizers.PATTERN)
        back = {c: b for b, c in enumerate(byte_table())}
        vocabulary = sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])
        pieces = [b""] * (vocabulary[-1][1] + 1)
        for t, i in vocabulary:
            pieces[i] = bytes(map(back.__getitem__, t))
        _loaded[path] = tokenizer, pieces
    return _loaded[path]


def character_ranges(pieces: Strings, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end of each id in the characters of its own text, and the bytes of all texts. counts: ids of each text."""
    data = np.frombuffer(pieces.joined(ids), np.uint8)
    before = np.r_[0, np.cumsum(data & 0xC0 != 0x80, dtype=np.int32)]  # leading bytes before each byte
    after = np.cumsum(pieces.size[ids])
    texts = np.r_[0, after][np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)]  # where each text's bytes begin
    base = np.repeat(before[texts], counts)
    first = after - pieces.size[ids]
    return before[first + 1] - 1 - base, before[after] - base, data


def encode_batches(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts, ends of each row of ``docs`` (doc_id, text): ids and their ranges of characters, arrays of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, piece = loaded(path)
        encoder, pieces = Encoder(tokenizer, REMEMBERED), Strings(piece)
        for b in batches:
            for at, n in slices(b.column(1), AT_ONCE):
                ids, counts = encoder.encode(b.column(1).slice(at, n))
                start, end, _ = character_ranges(pieces, ids, counts)
                edges = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (ids, start, end)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), *lists], ["doc_id", "ids", "starts", "ends"])

    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, schema)


def decode_batches(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded, decoded_text of each row of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Strings(loaded(path)[1])
        for b in batches:
            out = [pieces.joined(np.array(ids.as_py() or (), np.int64)) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["doc_id", "decoded", "decoded_text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").transform(mapped, run, "doc_id long, decoded binary, decoded_text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_crc32 of each row of ``docs`` (doc_id, text), and with
    ``with_ids`` the ids as little-endian unsigned 32-bit integers; one pass over the texts. n_split: ids that begin inside
    a character; offsets_crc32: unsigned, of each id's first character and the one after its last, as such integers."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, piece = loaded(path)
        encoder, pieces, numbers = Encoder(tokenizer, REMEMBERED), Strings(piece), Strings([b"%d," % i for i in range(len(piece))])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for at, n in slices(b.column(1), AT_ONCE):
                ids, counts = encoder.encode(b.column(1).slice(at, n))
                start, end, data = character_ranges(pieces, ids, counts)
                edges = np.cumsum(counts)[:-1]
                rows, ranges = np.split(ids, edges), np.split(np.stack([start, end], 1).astype("<u4"), edges)
                size = pieces.size[ids]
                stops = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)].astype(np.int64)].tolist()
                first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(ids) else np.zeros(0, np.int64)
                inside = np.r_[0, np.cumsum(data[first] & 0xC0 == 0x80)]
                split = np.diff(inside[np.r_[0, np.cumsum(counts)].astype(np.int64)])
                view = memoryview(data)
                columns = [b.column(0).slice(at, n), pa.array(counts, pa.int64())]
                columns += [pa.array([sha(memoryview(numbers.joined(x))[:-1]) for x in rows]), pa.array([sha(view[s:e]) for s, e in zip(stops, stops[1:])])]
                columns += [pa.array(split, pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in ranges], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, schema)
