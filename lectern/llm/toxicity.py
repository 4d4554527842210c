"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (operator 8).

A word is the bag of its character 3- to 5-grams (with its ends marked), hashed into ``BUCKETS`` rows; its
vector is their mean, a document's vector the mean of its words' vectors (with ``PAD`` zero vectors), and a linear
softmax over it gives the two classes. A text is scored by the worst of its stretches of ``STRETCH`` words, which overlap
by all but ``STEP`` of them, so neither a long text around an insult nor where it stands hides it. ``PAD`` and ``STRETCH``
were picked by cross-validation on folds 1 to 4 alone (balanced accuracy over a grid; figures in the README); fold 0 was not
looked at. Rows and softmax are trained together by full-batch Adam on at most ``TRAIN_ROWS`` labelled
documents outside fold 0; rows of n-grams that aren't found clearly more or less often in toxic documents
(``LEAST_Z``) stay zero, or a mean over thousands of n-grams would learn their noise. As mean and softmax are
both linear, a worker keeps one number for each word: unseen misspellings get theirs from the n-grams they
share with known words. Runs without white space of over ``LONGEST`` characters (Chinese, joined words) are cut into
pieces that overlap by four characters, so no n-gram is lost, and each piece weighs as a word.

Defined cases: an empty or null text has a zero vector and gets the softmax's intercept. Without labelled rows,
or with one class only, every score is that class's share (0 without any). Repeated rows get equal scores; a very long
text is read whole; an empty table gives no rows; columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fold, mapped, training_rows

TRAIN_ROWS = 4000
BUCKETS = 1 << 16
DIM = 4
EPOCHS = 100
#: Words with a zero vector that every mean has besides: a few odd words don't make a short text toxic.
PAD = 50
#: Words of a stretch, and from one to the next: a text is as toxic as the worst of its stretches, however long the rest is.
STRETCH = 300
STEP = 75
LEAST_Z = 3.5
LEAST_DOCS = 5
CUT = 0.5
#: Words that a worker remembers, and the most that it hashes at once.
REMEMBERED = 400_000
AT_ONCE = 20_000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|+=~_-…“”‘’«»/\\@^`"
#: Characters of a word or of a piece of one, and those that neighbouring pieces share: the longest n-gram's less one.
LONGEST = 64
SHARED = 4


def words_of(text: str) -> list[str]:
    """The raw words of a text; a longer one than LONGEST as its pieces, which begin with a blank and have the word's ends
    marked already."""
    raw = text.split()
    if len(text) <= LONGEST or max(map(len, raw), default=0) <= LONGEST:
        return raw
    out = []
    for x in raw:
        if len(x) <= LONGEST or len(w := x.strip(EDGE).lower()) <= LONGEST:
            out.append(x)
            continue
        for k in range(0, len(w) - SHARED, LONGEST - SHARED):
            out.append(" " + "<" * (k == 0) + w[k : k + LONGEST] + ">" * (k + LONGEST >= len(w)))
    return out


def subwords(raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """owner, bucket of each character n-gram of the words: the position of its word, and its row."""
    words = [x[1:] if x[:1] == " " else f"<{w}>" if (w := x.strip(EDGE).lower()) else "" for x in raw]
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    owners, buckets = [], []
    for n in (3, 4, 5):
        m = len(point) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ point[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][inside])
        buckets.append((h[inside] >> np.uint64(8)).astype(np.int64) % BUCKETS)
    return (np.concatenate(owners), np.concatenate(buckets)) if owners else (np.zeros(0, int), np.zeros(0, int))


@dataclass
class Model:
    rows: np.ndarray  # one number per bucket: its vector times the difference of the softmax's columns
    bias: float


class Logits(dict):
    """raw word → its logit (nan: no word)."""

    def __init__(self, model: Model):
        self.model = model

    def learn(self, raw: set[str]) -> None:
        new = [w for w in raw if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(raw)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            owner, bucket = subwords(part)
            with np.errstate(invalid="ignore"):
                mean = np.bincount(owner, self.model.rows[bucket], len(part)) / np.bincount(owner, minlength=len(part))
            self.update(zip(part, mean.tolist()))


def score(text: str | None, logits: Logits) -> float:
    raw = words_of(text or "")
    if any(w not in logits for w in raw):
        logits.learn(set(raw))
    z = np.fromiter(map(logits.__getitem__, raw), float, len(raw))
    z = z[~np.isnan(z)]
    ends = np.minimum(np.arange(STRETCH, max(len(z), 1) + max(STRETCH, STEP), STEP), len(z))  # the last stretch ends with the text
    starts = np.maximum(0, ends - STRETCH)
    sums = np.r_[0.0, np.cumsum(z)]
    total = logits.model.bias + float(((sums[ends] - sums[starts]) / (ends - starts + PAD)).max())
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def bag(text: str, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and what share each has of its mean; known: raw word → buckets, shares."""
    counts = Counter(words_of(text))
    if new := [w for w in counts if w not in known]:
        owner, bucket = subwords(new)
        order = np.argsort(owner, kind="stable")
        size = np.bincount(owner, minlength=len(new))
        known.update(zip(new, np.split(bucket[order], np.cumsum(size)[:-1])))
    items = [(g, n) for w, n in counts.items() if len(g := known[w])]
    if not items:
        return np.zeros(0, int), np.zeros(0)
    total = sum(n for _, n in items) + PAD
    ids = np.concatenate([g for g, _ in items])
    share = np.repeat([n / total / len(g) for g, n in items], [len(g) for g, _ in items])
    found, at = np.unique(ids, return_inverse=True)
    return found, np.bincount(at, share)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = 0.1) -> Model:
    y, n = np.array([t for _, t in rows], int), len(rows)
    if not n or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 60.0 if n and y[0] else -60.0)
    known: dict = {}
    bags = [bag(text, known) for text, _ in rows]
    known.clear()
    seen = np.zeros((2, BUCKETS))
    for (found, _), t in zip(bags, y):
        seen[t, found] += 1
    toxic, clean = y.sum(), n - y.sum()
    p = (seen.sum(0) + 1) / (n + 2)
    z = (seen[1] / toxic - seen[0] / clean) / np.sqrt(p * (1 - p) * (1 / toxic + 1 / clean))
    kept = np.flatnonzero((abs(z) > LEAST_Z) & (seen.sum(0) >= LEAST_DOCS))
    row = np.full(BUCKETS, -1)
    row[kept] = np.arange(len(kept))
    parts = [(np.full(m.sum(), d), row[found[m]], 100 * share[m]) for d, (found, share) in enumerate(bags) if (m := row[found] >= 0).any()]
    doc, col, share = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def spread(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, k], size) for k in range(DIM)], 1)

    rng = np.random.default_rng(5)
    params = [rng.normal(0, 0.01, (len(kept), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    weight = np.where(y > 0, min(3.0, clean / toxic), 1.0)
    weight /= weight.sum()
    target = np.eye(2)[y]
    for step in range(1, epochs + 1):
        table, out, bias = params
        docs = spread(doc, table[col] * share[:, None], n)
        logit = docs @ out + bias
        prob = np.exp(logit - logit.max(1, keepdims=True))
        gz = (prob / prob.sum(1, keepdims=True) - target) * weight[:, None]
        grads = [spread(col, (gz @ out.T)[doc] * share[:, None], len(kept)) + 1e-5 * table, docs.T @ gz, gz.sum(0)]
        for x, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    table, out, bias = params
    all_rows = np.zeros(BUCKETS)
    all_rows[kept] = 100 * (table @ (out[:, 1] - out[:, 0]))
    return Model(all_rows, float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = Logits(model)
        for b in batches:
            out: list[float] = []
            for at in range(0, b.num_rows, 100):  # new words of some documents at once
                texts = b.column(1).slice(at, 100).to_pylist()
                logits.learn(set(chain.from_iterable(words_of(t) for t in texts if t)))
                out += [score(t, logits) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labelled`` (doc_id, text) with ``labels`` (doc_id, toxic) and score ``docs``."""
    return scored(docs, fit(training_rows(labelled, labels, "toxic", TRAIN_ROWS)))
