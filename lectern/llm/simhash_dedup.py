"""SimHash near-duplicates by covering locality-sensitive hashing (operator 3).

Fingerprint: the words of the text with A-Z lower-cased, 3-word shingles with repeats, the majority of each
bit of their XXH64 (seed 42). Two fingerprints link at 3 or fewer differing bits.

Covering family for radius r: every bit i gets a vector m(i) of r + 1 bits, and each non-zero v of as many
bits a table that keeps the bits with <m(i), v> = 1. Any r positions leave a v orthogonal to all their
vectors, so a pair within the radius agrees on all kept bits of that table: 15 tables find every link.

Buckets hold distinct fingerprints only (copies are grouped first). A bucket of over ``BUCKET``
fingerprints isn't searched but sent, streaming, to a second family over the bits its table left
open, and from there to a third; that leaves at most 2**MAX_OPEN values in a bucket. No pair lists: a bucket
of k fingerprints gives at most k - 1 links that span its clusters.

Defined cases: a null or wordless text has fingerprint zero and links like any other. A row whose doc_id is
null keeps its fingerprint and gets a null component. Repeated doc_ids give repeated rows. A very long text is read whole,
``STRIDE`` shingles at a time; an empty table gives no rows; columns beside doc_id and text don't matter, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, mapped

RADIUS = 3
BUCKET = 4096
#: Shingles counted at once: bounds the memory that a very long text takes.
STRIDE = 65_536


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n, counts = xxhash.xxh64_intdigest, max(1, len(words) - 2), np.zeros(64, np.int64)
    for at in range(0, n, STRIDE):
        part = words[at : min(at + STRIDE, n) + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) > 2 else [b" ".join(words)]
        h = np.array([digest(s, 42) for s in shingles], np.uint64)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, run, "doc_id long, fp long")


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions ``bits``: each pair that differs in at most ``radius`` of them agrees under some mask."""
    vectors = {b: 1 + k % (2 ** (radius + 1) - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vectors[b] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ALL = (1 << 64) - 1
FIRST = covering(list(range(64)))


def refined(fixed: int) -> list[int]:
    """For buckets that agree on the bits ``fixed``: masks that keep those and half of the others."""
    return [fixed | m for m in covering([b for b in range(64) if not fixed >> b & 1])]


SECOND = [m for f in FIRST for m in refined(f)]
THIRD = [m for f in SECOND for m in refined(f)]
MAX_OPEN = max(64 - m.bit_count() for m in THIRD)


def spanning(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``fp``: a search that visits each fingerprint once."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(rep[x]), int(rep[y])) for y in found]
                queue += found.tolist()
    return out


def bucket_links(keyed: DataFrame, radius: int, most: int) -> DataFrame:
    """keyed: mask, key, fp, rep. Returns a, b, over: links of representatives, or with ``over`` the mask's
    number the fingerprints (a) and representatives (b) of a bucket that has more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # what has come of the last bucket
        over = False  # whether that bucket has passed the bound

        def rows(a, b, mask) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int32())], ["a", "b", "over"])

        def emit(links) -> pa.RecordBatch:
            return rows([x for x, _ in links], [y for _, y in links], [-1] * len(links))

        def close() -> Iterator[pa.RecordBatch]:
            if held and not over and sum(len(h[2]) for h in held) > 1:
                yield emit(spanning(np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), radius))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(mask)]
            if held and not (held[0][0][0] == mask[0] and held[0][1][0] == key[0]):
                yield from close()
                over = False
            size, links = ends - starts, []
            for i in np.flatnonzero(size > 1) if len(size) > 2 else []:
                s, e = starts[i], ends[i]
                if i in (0, len(size) - 1):
                    continue
                if e - s > most:
                    yield rows(fp[s:e], rep[s:e], mask[s:e])
                elif e - s == 2:
                    if (int(fp[s]) ^ int(fp[s + 1])) & ALL and ((int(fp[s]) ^ int(fp[s + 1])) & ALL).bit_count() <= radius:
                        links.append((int(rep[s]), int(rep[s + 1])))
                else:
                    links += spanning(fp[s:e], rep[s:e], radius)
            for i in sorted({0, len(size) - 1}):  # those that may go on in another batch
                if i:
                    yield from close()
                    over = False
                s, e = starts[i], ends[i]
                held.append((mask[s:e], key[s:e], fp[s:e], rep[s:e]))
                if over or sum(len(h[2]) for h in held) > most:
                    for h in held if not over else held[-1:]:
                        yield rows(h[2], h[3], h[0])
                    over = True
                    del held[1:]
            if links:
                yield emit(links)
        yield from close()

    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").transform(mapped, run, "a long, b long, over int")


def keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    return nodes.select(F.explode(tables).alias("t"), "fp", "rep").select("t.mask", "t.key", "fp", "rep")


def finer(over: DataFrame, masks: list[int]) -> DataFrame:
    """The overfull buckets dealt out anew: 15 masks for each one they come from."""
    n, table = 2 ** (RADIUS + 1) - 1, F.array(*[F.lit(signed(m)) for m in masks])
    out = over.select(F.explode(F.sequence(F.col("over") * n, F.col("over") * n + n - 1)).alias("mask"), F.col("a").alias("fp"), F.col("b").alias("rep"))
    return out.select("mask", F.col("fp").bitwiseAND(F.get(table, F.col("mask"))).alias("key"), "fp", "rep")


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect the representatives of all fingerprints within ``radius``; nodes: fp, rep."""
    found = cut(bucket_links(keys(nodes, FIRST), radius, bucket))
    out = found.where("over < 0")
    for masks, most in ((SECOND, bucket), (THIRD, max(bucket, 2**MAX_OPEN))):
        over = found.where("over >= 0")
        if over.isEmpty():
            break
        found = cut(bucket_links(finer(over, masks), radius, most))
        out = out.union(found.where("over < 0"))
    return out.select("a", "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of ``edges`` (a, b). Alternating large-star
    and small-star contraction; each round is cut to the checkpoint folder, nothing is gathered on the driver."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = cut(small)
        if e.count() == after.count() and after.join(e, ["u", "v"], "left_anti").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        e = after


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the covering family is built for a radius up to {RADIUS}")
    prints = cut(fingerprints(docs))
    nodes = cut(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes, radius, bucket))
    names = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(names, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those without a doc_id."""
    from lectern.llm.common import without_ids

    return without_ids(docs, cut(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()))
