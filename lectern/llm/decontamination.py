"""Benchmark decontamination by template canonicalisation (operator 5).

Numbers, names and units become typed placeholders, so a question whose figures or people were exchanged has the
template of the original. Windows of ``WINDOW`` template tokens of the documents are hash-joined with those of the
benchmark; what a document and an item share is judged along their diagonals (document position minus item position, in
overlapping bands of 2 * ``DRIFT``), and the best band decides: ``CONTAINED`` of the item's windows found there, with the
fillers of its slots consistent (each filler of the item stands for one filler in the document), or a run of
``RUN_WORDS`` tokens with the same fillers throughout.

Tokens are the white-space separated words without the marks around them. ``<num>``: begins with a digit;
``<unit>``: a word of ``UNITS`` after a number; ``<name>``: begins with a capital, also where a sentence begins, and
neighbouring names with no mark between them are one. Windows with under ``LITERALS`` plain words tell nothing and
aren't looked at.

Documents and items are read in three ways, each with windows of its own: with these tokens; word by word with case
folded, so that every window tells (capitals, lower-cased copies, items of names or numbers); and with tokens that don't
depend on case: a word is plain if the benchmark has it in small letters somewhere, else a name (copies in one case whose
figures or people were exchanged). The first way that finds an item gives its row. An item of fewer than ``WINDOW`` words
has one window, all of its words with case folded.

Plan: items are normalised, grouped and numbered once. One scan of the documents makes their windows; a Bloom filter of
the benchmark's (``MAX_BITS`` at most, so its size is bounded; a full one only lets more pass) leaves out most that no item
has. What is left is joined by hash and counted by document and item; pairs with enough shared windows are joined once
more with positions and fillers, and judged group by group. Joins broadcast the benchmark only up to ``BROADCAST_WINDOWS``
windows and ``BROADCAST_CHARS`` characters, else Spark shuffles.

Defined cases: null, empty and wordless texts match nothing and wordless items are left out; items that are equal but for
white space count as one, which has the smallest item_id; an empty benchmark finds nothing, an empty table has no rows.
Rows keep their doc_id, null or repeated, and each repeated row has rows of its own; a very long text is read whole; columns
beside doc_id and text, item_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_IDS, cut, mapped

WINDOW = 5
LITERALS = 2
CONTAINED = 0.8
CONSISTENT = 0.8
RUN_WORDS = 13
#: Diagonals this near each other belong together.
DRIFT = 8
#: Bits of a Bloom filter for each hash, in all at least and at most, in a piece of it that comes to the driver; its probes.
KEY_BITS, LEAST_BITS, MAX_BITS, PIECE_BITS = 24, 1 << 15, 1 << 27, 1 << 15
PROBES = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Most windows and characters of a benchmark that a join broadcasts.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_CHARS = 32_000_000
#: Words whose codes a worker remembers, and words that are looked up at once (but one text at least).
REMEMBERED = 200_000
AT_ONCE = 200_000
#: A word between two texts; no window passes it.
BETWEEN = "\x00"

MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "…“”‘’«»–—¿¡·•"
UNITS = frozenset(
    "m cm mm km kg g mg t lb lbs oz l ml ft in inch inches foot feet yard yards mile miles meter meters metre metres "
    "gram grams kilogram kilograms liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent dollar dollars euro euros cent cents pound pounds usd eur degree degrees".split()
)
#: Tokens: 0 stands between texts, these for what may be exchanged; from FIRST on a token is a word's hash.
NUM, NAME, UNIT, FIRST = 1, 2, 3, 4
#: Flags of a word: what kind it is (NUM, NAME or 0), and the others times these.
KINDS, IS_UNIT, CLOSED, PLAIN, BREAK, NONE = 3, 4, 8, 16, 32, 64
TEMPLATE, WORDS, CASELESS = range(3)
SCHEMA = "doc_id long, item_id long, n_windows int, n_found int, containment double, consistency double, verbatim_words int, reparameterised boolean"


def core(word: str) -> str:
    return word.strip(MARKS)


def kind_of(c: str) -> int:
    return NUM if c[0].isdigit() else NAME if c[0].isupper() else 0


def hash_of(c: str) -> int:
    """Of a word's core with case folded; none is below FIRST."""
    return max(FIRST, xxhash.xxh64_intdigest(c.casefold().encode("utf-8", "surrogatepass")))


@dataclass
class Filter:
    """A Bloom filter of 64-bit hashes."""

    shift: int
    bits: np.ndarray  # uint8, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        """Each probe looks only at what the ones before it left."""
        left = np.arange(len(h))
        for k in PROBES:
            at = ((h[left] * k) >> np.uint64(self.shift)).astype(np.int64)
            left = left[self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
        found = np.zeros(len(h), bool)
        found[left] = True
        return found


def positions(h: np.ndarray, shift: int) -> list[np.ndarray]:
    return [((h * k) >> np.uint64(shift)).astype(np.int64) for k in PROBES]


def bloom(hashes: DataFrame, n: int) -> Filter:
    """Of the column hash, n rows: set bits are made distinct and packed in Spark, MAX_BITS come to the driver at most."""
    size = min(MAX_BITS, max(LEAST_BITS, 1 << (KEY_BITS * n).bit_length()))
    shift = 64 - (size.bit_length() - 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(positions(b.column(0).to_numpy().view(np.uint64), shift)))
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE_BITS, pa.int32()), pa.array(at % PIECE_BITS, pa.int32())], ["piece", "bit"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PIECE_BITS, np.uint8)
        bits[pdf.bit.to_numpy()] = 1
        return pd.DataFrame({"piece": [pdf.piece.iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    set_bits = hashes.select("hash").transform(mapped, spread, "piece int, bit int").distinct()
    out = np.zeros(size // 8, np.uint8)
    for r in set_bits.groupBy("piece").applyInPandas(pack, "piece int, bits binary").collect():
        out[r.piece * (PIECE_BITS // 8) :][: PIECE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(shift, out)


class Lexicon(dict):
    """word → its number in this process; hashes and flags hold by number what it is."""

    def __init__(self, plain: Filter):
        self.plain = plain
        self.start()

    def start(self) -> None:
        self.clear()
        self.hashes, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of words, those that are new looked up in the filter all at once."""
        if len(self) > REMEMBERED:
            self.start()
        known = len(self)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = slice(known, len(self))
        told = self.plain.has(self.hashes[new]) & (self.flags[new] & (NONE | BREAK) == 0)
        self.flags[new] |= PLAIN * told
        return out

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.hashes):
            self.hashes, self.flags = np.r_[self.hashes, np.zeros_like(self.hashes)], np.r_[self.flags, np.zeros_like(self.flags)]
        c = core(word)
        if not c or word == BETWEEN:
            self.flags[k] = NONE if not c else BREAK
        else:
            self.hashes[k] = hash_of(c)
            self.flags[k] = kind_of(c) + IS_UNIT * (c.casefold() in UNITS) + CLOSED * (not word.endswith(c[-1:]))
        self[word] = k
        return k


@dataclass
class Reading:
    token: np.ndarray  # uint64
    first: np.ndarray  # the word that a token begins with, and the hash of that which it ends with: its filler, if it is a slot
    filler: np.ndarray


def readings(words: list[str], lexicon: Lexicon) -> list[Reading]:
    """The three ways to read a list of words."""
    number = lexicon.numbers(words)
    flags = lexicon.flags[number]
    at = np.flatnonzero(flags & NONE == 0)
    h, flags = lexicon.hashes[number][at], flags[at]
    kind = flags & KINDS
    caseless = np.where(kind == NUM, NUM, np.where(flags & (PLAIN | BREAK) > 0, h, NAME)).astype(np.uint64)
    template = np.where(kind > 0, kind.astype(np.uint64), h)
    return [merged(template, h, flags, kind == 0, at), Reading(h, at, h), merged(caseless, h, flags, kind != NUM, at)]


def merged(token: np.ndarray, h: np.ndarray, flags: np.ndarray, may_be_unit: np.ndarray, at: np.ndarray) -> Reading:
    """Units after numbers, and neighbouring names as one."""
    if not len(token):
        return Reading(token, at, h)
    before = np.r_[np.uint64(0), token[:-1]]
    token = np.where((flags & IS_UNIT > 0) & may_be_unit & (before == NUM), np.uint64(UNIT), token)
    goes_on = np.r_[False, (token[1:] == NAME) & (token[:-1] == NAME) & (flags[:-1] & CLOSED == 0)]
    start = np.flatnonzero(~goes_on)
    return Reading(token[start], at[start], h[np.r_[start[1:] - 1, len(at) - 1]])


def window_hashes(token: np.ndarray, reading: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """hash of each telling window of ``size`` tokens, and where it begins; no two readings or sizes share hashes."""
    if len(token) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    plain, known = np.r_[0, np.cumsum(token >= FIRST)], np.r_[0, np.cumsum(token > 0)]
    at = np.flatnonzero((known[size:] - known[:-size] == size) & (plain[size:] - plain[:-size] >= min(size, LITERALS)))
    h = np.full(len(at), 8 * reading + size, np.uint64)
    for k in range(size):
        h = (h ^ token[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, at


def item_windows(read: list[Reading]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """reading, size, hashes, positions of an item's windows, for each way to read it that has any."""
    for reading, r in enumerate(read):
        size = min(WINDOW, len(r.token)) if reading == WORDS else WINDOW
        if size:
            h, at = window_hashes(r.token, reading, size)
            if len(h):
                yield reading, size, h, at


def least(n_windows: int) -> float:
    """Windows of an item that must be in a text for it to be contained, or to have a run."""
    return min(CONTAINED * n_windows, RUN_WORDS - WINDOW + 1)


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first before the others, and where each group of equal ones begins in it, with the end."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        new |= np.diff(k[order]) != 0
    return order, np.r_[0, np.flatnonzero(new) + 1, len(order)] if len(order) else np.zeros(1, np.int64)


def numbered(benchmark: DataFrame) -> DataFrame:
    """item, item_id, text of the different items of ``benchmark`` (item_id, text): white space as one space, none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join((t or "").split()) for t in b.column(1).to_pylist()], pa.string())], ["item_id", "text"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "item_id long, text string")
    return cut(rows.where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id")).select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))


def small_words(items: DataFrame) -> DataFrame:
    """hash of each word that an item has in small letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {c.casefold() for t in b.column(0).to_pylist() for w in t.split() if (c := core(w)) and not kind_of(c)}
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(map(hash_of, found)), np.uint64).view(np.int64))], ["hash"])

    return items.select("text").transform(mapped, run, "hash long").distinct()


def benchmark_windows(items: DataFrame, plain: Filter) -> DataFrame:
    """item, reading, size, hash, qs: the different windows of each item, and where in it they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(plain)
        for b in batches:
            parts = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for reading, size, h, at in item_windows(readings(text.split(), lexicon)):
                    order, edges = grouped(h)
                    n = len(edges) - 1
                    parts.append((np.full(n, item), np.full(n, reading), np.full(n, size), h[order][edges[:-1]].view(np.int64), at[order], np.diff(edges)))
            if parts:
                item, reading, size, h, at, n = map(np.concatenate, zip(*parts))
                columns = [pa.array(item, pa.int64()), pa.array(reading, pa.int32()), pa.array(size, pa.int32()), pa.array(h, pa.int64()), lists(at, np.r_[0, np.cumsum(n)], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "reading", "size", "hash", "qs"])

    return items.select("item", "text").transform(mapped, run, "item long, reading int, size int, hash long, qs array<int>")


def hits(docs: DataFrame, seen: Filter, plain: Filter, sizes: list[int], needed: dict[int, float]) -> DataFrame:
    """uid, doc_id, digest, hash, at, fills: for each row of ``docs`` its different windows that the benchmark may have, where
    they are, and the fillers of their slots (WINDOW for each place, 0: no slot; none if windows have no slots). uid: of the
    row. needed: of each reading, the least different windows that any item must share; texts with fewer have no rows."""
    schema = "uid long, doc_id long, digest binary, hash long, at array<int>, fills array<long>"

    def found(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, ...]:
        """text, hash, position, fillers or none, of each window of the texts that the filter has."""
        words, ends = [], []
        for t in texts:
            words += (t or "").split()
            words.append(BETWEEN)
            ends.append(len(words))
        out = []
        for reading, r in enumerate(readings(words, lexicon)):
            if reading not in needed:
                continue
            for size in sizes if reading == WORDS else [WINDOW]:
                h, at = window_hashes(r.token, reading, size)
                k = np.flatnonzero(seen.has(h))
                h, at = h[k], at[k]
                text = np.searchsorted(ends, r.first[at], "right")
                # a text needs as many different windows as the item that needs fewest
                order, edges = grouped(text, h)
                different = np.bincount(text[order][edges[:-1]], minlength=len(texts)) if len(h) else np.zeros(len(texts))
                enough = different[text] >= (needed[reading] if size == WINDOW else 1) if len(h) else np.zeros(0, bool)
                h, at, text = h[enough], at[enough], text[enough]
                if reading == WORDS:
                    fills = np.zeros((len(h), WINDOW), np.uint64)
                else:
                    where = at[:, None] + np.arange(WINDOW)
                    fills = np.where(r.token[where] < FIRST, r.filler[where], np.uint64(0))
                out.append((text, h, at, fills))
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, lexicon = TaskContext.get().partitionId() << 33, Lexicon(plain)
        for b in batches:
            texts = b.column(1).to_pylist()
            size = np.cumsum([len(t or "") // 6 + 1 for t in texts])
            part = (size - size[:1]) // AT_ONCE
            for e in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1) if texts else []:
                mine = [texts[k] for k in e]
                text, h, at, fills = found(mine, lexicon)
                order, edges = grouped(text, h)
                if len(h):
                    first = order[edges[:-1]]
                    digest = {k: hashlib.md5(mine[k].encode("utf-8", "surrogatepass")).digest() for k in np.unique(text).tolist()}
                    slots = np.diff(edges) * WINDOW * (np.logical_or.reduceat(fills[order].any(1), edges[:-1]))
                    kept = np.repeat(slots > 0, np.diff(edges))
                    columns = [pa.array(row + text[first], pa.int64()), b.column(0).take(pa.array(e[0] + text[first])), pa.array([digest[k] for k in text[first].tolist()], pa.binary())]
                    columns += [pa.array(h[first].view(np.int64)), lists(at[order], edges, pa.int32()), lists(fills[order][kept].ravel().view(np.int64), np.r_[0, np.cumsum(slots)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])
                row += len(e)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, schema)


@dataclass
class Shared:
    """A window that a document and an item share: where in the document, its fillers there (None: no slots), where in the item."""

    at: np.ndarray  # ascending
    fills: np.ndarray | None  # (places, WINDOW)
    qs: np.ndarray


#: Pairs of places that are laid out at once; where a document and an item share more, bands are laid out one by one.
PAIRS = 1_000_000


def bands(shared: list[Shared], least_pairs: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """p, q and fillers of the pairs of places on 2 * DRIFT neighbouring diagonals, for each such band (they overlap by half)
    with enough pairs."""
    if sum(len(s.at) * len(s.qs) for s in shared) <= PAIRS:
        p = np.concatenate([np.tile(s.at, len(s.qs)) for s in shared])
        q = np.concatenate([np.repeat(s.qs, len(s.at)) for s in shared])
        fills = np.concatenate([np.tile(s.fills, (len(s.qs), 1)) if s.fills is not None else np.zeros((len(s.at) * len(s.qs), WINDOW), np.uint64) for s in shared])
        cell = (p - q) // DRIFT
        order = np.argsort(cell, kind="stable")
        p, q, fills, cell = p[order], q[order], fills[order], cell[order]
        starts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
        for k in range(len(starts) - 1):
            further = k + 2 < len(starts) and cell[starts[k + 1]] == cell[starts[k]] + 1
            end = starts[k + 2] if further else starts[k + 1]
            if end - starts[k] >= least_pairs:
                yield p[starts[k] : end], q[starts[k] : end], fills[starts[k] : end]
        return
    cells: dict[int, int] = defaultdict(int)
    for s in shared:
        for q in s.qs.tolist():
            for c, n in zip(*map(np.ndarray.tolist, np.unique((s.at - q) // DRIFT, return_counts=True))):
                cells[c] += n
    for c in sorted(cells):
        if cells[c] + cells.get(c + 1, 0) >= least_pairs:
            yield band(shared, c * DRIFT, (c + 2) * DRIFT)


def judge(shared: list[Shared], item: Reading, size: int, n_windows: int) -> tuple[int, float, int] | None:
    """(found, consistency, verbatim words) of the best band of diagonals, or None if none is contamination."""
    best = None
    for p, q, fills in bands(shared, least(n_windows)):
        found = len(np.unique(q))
        if found < least(n_windows):
            continue
        # tokens of the pairs, each once: in document and item, with the document's filler
        k = np.arange(size)
        a, b, mine = (p[:, None] + k).ravel(), (q[:, None] + k).ravel(), fills[:, :size].ravel()
        order, edges = grouped(a - b, b)
        a, b, mine = (x[order][edges[:-1]] for x in (a, b, mine))
        kind, theirs = item.token[b], item.filler[b]
        slot = kind < FIRST
        slots: dict[tuple[int, int], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for x, y, z in zip(kind[slot].tolist(), theirs[slot].tolist(), mine[slot].tolist()):
            slots[x, y][z] += 1
        again = [x for x in slots.values() if sum(x.values()) > 1]  # fillers that occur once can't contradict themselves
        consistency = sum(max(x.values()) for x in again) / sum(sum(x.values()) for x in again) if again else 1.0
        same = ~slot | (mine == theirs)
        goes_on = np.r_[False, same[1:] & same[:-1] & (np.diff(a - b) == 0) & (np.diff(b) == 1)]
        starts = np.flatnonzero(~goes_on)
        run = int(np.add.reduceat(same.astype(np.int64), starts).max())
        if found >= CONTAINED * n_windows and consistency >= CONSISTENT or run >= RUN_WORDS:
            best = max(best or (0, 0.0, 0), (found, consistency, run))
    return best


def band(shared: list[Shared], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, q, fillers of the pairs of places with low <= p - q < high."""
    ps, qs, fills = [], [], []
    for s in shared:
        for q in s.qs.tolist():
            i, j = np.searchsorted(s.at, (q + low, q + high))
            if j > i:
                ps.append(s.at[i:j]), qs.append(np.full(j - i, q))
                fills.append(s.fills[i:j] if s.fills is not None else np.zeros((j - i, WINDOW), np.uint64))
    return np.concatenate(ps), np.concatenate(qs), np.concatenate(fills)


def judged(pairs: DataFrame, plain: Filter) -> DataFrame:
    """The pairs (uid, doc_id, digest, item, item_id, text, reading, size, n_windows, shared) that are contamination."""
    keys = "uid long, doc_id long, digest binary, item long, item_id long, reading int"
    schema = f"{keys}, n_windows int, n_found int, containment double, consistency double, verbatim_words int, reparameterised boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(plain)
        known: dict[int, list[Reading]] = {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if len(known) > 10_000:
                    known.clear()
                if r["item"] not in known:
                    known[r["item"]] = readings(r["text"].split(), lexicon)
                read = known[r["item"]][r["reading"]]
                shared = []
                for s in r["shared"]:
                    at, fills = np.array(s["at"], np.int64), np.array(s["fills"], np.int64).view(np.uint64).reshape(-1, WINDOW)
                    order = np.argsort(at, kind="stable")
                    shared.append(Shared(at[order], fills[order] if len(fills) else None, np.array(s["qs"], np.int64)))
                if got := judge(shared, read, r["size"], r["n_windows"]):
                    found, consistency, run_words = got
                    whole = run_words >= min(len(read.token), RUN_WORDS)
                    rows.append([*(r[k.split()[0]] for k in keys.split(", ")), r["n_windows"], found, found / r["n_windows"], consistency, run_words, not whole])
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], [x.split()[0] for x in schema.split(", ")])

    return pairs.transform(mapped, run, schema)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """``judged`` for each row of ``docs`` and item that it contains, the first reading's; None if there are no items."""
    items = numbered(benchmark)
    small = cut(small_words(items))
    plain = bloom(small, small.count())
    windows = cut(benchmark_windows(items, plain))
    n = windows.count()
    if not n:
        return None
    seen = bloom(windows, n)
    entries = windows.groupBy("item", "reading", "size").agg(F.sum(F.size("qs")).cast("int").alias("n_windows"), F.max(F.size("qs")).alias("again"))
    fewest = F.least(F.lit(CONTAINED) * F.col("n_windows"), F.lit(float(RUN_WORDS - WINDOW + 1)))
    rows = entries.where(F.col("size") == WINDOW).groupBy("reading").agg(F.min(fewest / F.col("again")).alias("n")).collect()
    sizes = sorted(r[0] for r in windows.where(F.col("reading") == WORDS).select("size").distinct().collect())
    needed = {WORDS: 1.0} | {r.reading: r.n for r in rows}
    found = cut(hits(docs, seen, plain, sizes, needed))
    small_enough = lambda df, ok: F.broadcast(df) if ok else df
    few = n <= BROADCAST_WINDOWS
    counts = found.select("uid", "hash").join(small_enough(windows.select("hash", "item", "reading", F.size("qs").alias("n")), few), "hash").groupBy("uid", "item", "reading").agg(F.sum("n").alias("n"))
    near = cut(counts.join(entries, ["item", "reading"]).where(F.col("n") >= fewest).select("uid", "item", "reading", "size", "n_windows"))
    met = found.join(small_enough(windows.select("hash", "item", "reading", "qs"), few), "hash").join(near, ["uid", "item", "reading"])
    pairs = met.groupBy("uid", "item", "reading", "size", "n_windows").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.collect_list(F.struct("at", "fills", "qs")).alias("shared"))
    short = (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_CHARS
    told = judged(pairs.join(small_enough(items, short), "item"), plain)
    values = [x.split()[0] for x in SCHEMA.split(", ")]
    first = told.groupBy("uid", "item").agg(F.min_by(F.struct("digest", *values), "reading").alias("x"))
    return first.select("x.digest", *[f"x.{v}" for v in values])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``SCHEMA`` for each row of ``docs`` and benchmark item that it contains; documents that contain none have no row."""
    found = matches(docs, benchmark)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found.drop("digest")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were: those whose text isn't that of a row that does."""
    found = matches(docs, benchmark)
    if found is None:
        return docs
    name = "digest"
    while name in docs.columns:
        name += "_"
    gone = cut(found.select(F.col("digest").alias(name)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = docs.withColumn(name, F.unhex(F.md5(F.col("text").cast("string").cast("binary"))))
    return keyed.join(F.broadcast(gone) if few else gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
