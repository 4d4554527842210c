"""Quality classifier: naive Bayes support vectors (operator 6).

Binary indicators of n-grams (words, punctuation runs, and one- to three-grams of word shapes) are scaled by
the log-count ratios of the two classes; a linear hinge-loss model with an intercept is fitted to them by dual
coordinate descent. Indicators are hashed whole into ``BUCKETS`` columns, so a text's indicators depend on the text alone,
whatever a worker saw before. Labels come from at most ``TRAIN_ROWS`` labelled documents outside fold 0, read as whole
texts.

Defined cases: an empty or null text has no n-grams and gets the score of the intercept. Without labelled
rows, or with one class only, every score is that class's share (1.0 without any). Repeated rows get equal scores; a very
long text is read whole; an empty table gives no rows; columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fold, mapped, training_rows

#: Most labelled documents that the classifier is fitted on.
TRAIN_ROWS = 6000
#: Columns that indicators are hashed into, and the labelled documents that one must be in to count.
BUCKETS = 1 << 20
MIN_DOCS = 3
CUT = 0.3
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000

PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
#: A mark that stands three times or more counts as three.
RUN = re.compile(r"(.)\1{2,}", re.S)
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {value}".encode("utf-8", "surrogatepass"))


class Words(dict):
    """raw word → its number in this process; shape, plain and marks hold by number the hash of its shape, the column of
    the word and that of the marks after it (the word's again where there are none)."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.clear()
        self.shape, self.plain, self.marks = np.zeros(1024, np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.place = np.zeros(BUCKETS, np.int32)

    def __missing__(self, word: str) -> int:
        before, core, after = ("", word, "") if word.isalpha() else PARTS.match(word).groups()
        case = "-" if not core else "0" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a" if core.islower() else "x"
        k = len(self)
        if k >= len(self.shape):
            self.shape, self.plain, self.marks = (np.r_[x, np.zeros_like(x)] for x in (self.shape, self.plain, self.marks))
        after = RUN.sub(r"\1\1\1", after)
        self.shape[k] = hashed("shape", f"{RUN.sub(r'\1\1\1', before)}{case}{after}")
        self.plain[k] = hashed("word", core.lower()) % BUCKETS
        self.marks[k] = hashed("marks", after) % BUCKETS if after else self.plain[k]
        self[word] = k
        return k

    def distinct(self, columns: np.ndarray) -> np.ndarray:
        """Each column once, in linear time."""
        order = np.arange(len(columns), dtype=np.int32)
        self.place[columns] = order
        return columns[self.place[columns] == order]


def column_of(h: np.ndarray, n: int) -> np.ndarray:
    """Columns of hashes of n shapes."""
    h = (h ^ np.uint64(n)) * MIX
    return ((h ^ h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def indicators(text: str | None, words: Words) -> np.ndarray:
    """The columns of the n-gram indicators of a whole text, each once."""
    if len(words) > REMEMBERED:
        words.start()
    raw = (text or "").split()
    ids = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw))
    s = words.shape[ids]
    two = s[:-1] * MIX + s[1:]
    found = [words.plain[ids].astype(np.int64), words.marks[ids].astype(np.int64), column_of(s, 1), column_of(two, 2), column_of(two[:-1] * MIX + s[2:], 3)]
    if len(ids) > 2 and ((ids[2:] == ids[1:-1]) & (ids[1:-1] == ids[:-2])).any():
        found.append(np.array([hashed("text", "same same") % BUCKETS]))
    lines = [x for x in (text or "").split("\n") if x]
    if again := len(lines) - len(set(lines)):
        found.append(np.array([hashed("text", f"line again {min(3, again)}") % BUCKETS]))
    return words.distinct(np.concatenate(found))


@dataclass
class Model:
    weights: np.ndarray  # of each column
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * (float(np.sort(self.weights[found]).sum(dtype=np.float64)) + self.bias) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, c: np.ndarray, epochs: int = 15) -> np.ndarray:
    """Weights of min ½|w|² + Σ c_i max(0, 1 - y_i w·x_i); rows: (columns, values), y: ±1."""
    w, alpha, rng = np.zeros(n), np.zeros(len(rows)), np.random.default_rng(11)
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            cols, vals = rows[i]
            if not square[i]:
                continue
            g = y[i] * float(w[cols] @ vals) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            if new != alpha[i]:
                w[cols] += (new - alpha[i]) * y[i] * vals
                moved = max(moved, abs(new - alpha[i]) / c[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins ``z``; y: 0 or 1. Newton's method, smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g, k = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(k * z * z).sum() + 1e-6, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * z).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[tuple[str, int]], strength: float = 1.0) -> Model:
    y = np.array([q for _, q in rows], int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, (60.0 if not len(y) or y[0] else -60.0))
    words = Words()
    found = [np.sort(indicators(t, words)).astype(np.int32) for t, _ in rows]
    by = np.zeros((2, BUCKETS))
    for f, q in zip(found, y):
        by[q, f] += 1
    kept = np.flatnonzero(by.sum(0) >= MIN_DOCS)
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    # log-count ratio: share of the class's documents that have the n-gram, smoothed
    good, bad = int(y.sum()) + 2, int((1 - y).sum()) + 2
    ratio = np.log((by[1, kept] + 1) / good * bad / (by[0, kept] + 1))
    sparse = []
    for f in found:
        cols = place[f]
        cols = cols[cols >= 0]
        sparse.append((cols, ratio[cols]))
    constant = 0.1 * float(np.median([np.sqrt(v @ v) for _, v in sparse]) or 1.0)  # of every row, in the last column: the intercept
    sparse = [(np.r_[c, len(kept)], np.r_[v, constant]) for c, v in sparse]
    cost = strength / np.median([float(v @ v) for _, v in sparse]) * np.where(y > 0, 1.0, max(1.0, y.sum() / max(1, (1 - y).sum()) / 2))
    half = np.arange(len(y)) % 5 == 0  # margins of rows that the model hasn't seen, for the curve
    w = dual_descent([s for s, k in zip(sparse, half) if not k], np.where(y > 0, 1, -1)[~half], len(kept) + 1, cost[~half])
    z = np.array([w[c] @ v for (c, v), k in zip(sparse, half) if k])
    both = len(set(y[half].tolist())) == 2
    slope, shift = platt(z, y[half]) if both else (1.0, 0.0)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w[:-1] * ratio
    return Model(weights, float(w[-1] * constant), slope, shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(indicators(t.as_py(), words)) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labelled`` (doc_id, text) with ``labels`` (doc_id, quality) and score ``docs``."""
    return scored(docs, fit(training_rows(labelled, labels, "quality", TRAIN_ROWS)))


def keep_predicted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of quality, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            yield b.filter(pa.array([model.score(indicators(t.as_py(), words)) >= CUT for t in b.column(at)], pa.bool_()))

    return docs.transform(mapped, run, docs.schema)
