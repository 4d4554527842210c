"""Quality rules with robust multivariate outliers (operator 4).

Base statistics per document, then for each language and source a minimum-covariance-determinant estimate of
the transformed statistics; documents far from it by Mahalanobis distance are rejected.

The estimates cover every document of a group that passes the base rule. The transformed statistics are
counted in the cells of a fixed grid (count, sums and sums of products per cell, partial sums before the
shuffle), so a group brings one task at most the cells of the grid, however many documents it has; the
concentration steps order cells instead of documents and take the means and covariances from the exact sums.

A group's estimate is drawn towards its language's, and that towards the corpus's, as if each had ``PRIOR`` documents
more of the wider kind: groups of any size are judged by one formula, and a small one mostly as its language is.

``CUTOFF`` is the point that a Gaussian document passes with probability ``TAIL``. Variances are floored (``FLOOR``), so
a group whose statistics don't vary rejects nothing near its centre; the floors are low enough for each statistic to pass
the cutoff alone.

Defined cases: a null text has no words and fails the base rule. Null languages and sources are groups of
their own. Repeated rows count and are judged as often as they occur; a very long text is measured whole; an empty table
gives no rows; a group without a passing document has no estimate and null distances. ``keep_good`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, mapped, without_ids

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIN_WORDS = 50
#: Documents that the wider estimate counts for in that of a group or language.
PRIOR = 40.0
#: Share of a group that the estimate is made from.
SHARE = 0.75
#: Share of documents beyond the cutoff, were they Gaussian: heavy tails are common among clean documents.
TAIL = 1e-4
#: Least standard deviation of each transformed statistic, and the width of the grid's cells.
FLOOR = (0.45, 0.45, 0.45, 0.06)
CELL = (0.25, 0.25, 0.25, 0.05)
#: The grid ends here: larger values share the last cell.
TOP = (30.0, 7.0, 5.0, 1.0)
P = len(FLOOR)


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeated = 0
    if len(words) > 3:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < len(words) - 2:
            many = np.fromiter((windows[w] > 1 for w in zip(words, words[1:], words[2:])), bool, len(words) - 2)
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(many)] |= many
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame) -> DataFrame:
    """``STATS`` for each row of ``docs`` (doc_id, text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measure(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, got.T.copy())], [x.split()[0] for x in STATS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).transform(mapped, run, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]


def chi2_quantile(p: float, df: int) -> float:
    """Of an even number of degrees of freedom, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def chi2_cdf(x: float, df: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


#: Squared distance beyond which a document goes.
CUTOFF = chi2_quantile(1 - TAIL, P)


def mcd(count: np.ndarray, sums: np.ndarray, products: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the subset of cells that holds ``share`` of the rows and has the smallest
    determinant found. count: rows per cell; sums: (cells, P); products: (cells, P, P), sums of outer products."""
    total, centres, floor = count.sum(), sums / count[:, None], np.diag(np.square(FLOOR))
    h = math.ceil(share * total)

    def fit(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (weight * count).sum()
        mean = (weight[:, None] * sums).sum(0) / n
        return mean, (weight[:, None, None] * products).sum(0) / n - np.outer(mean, mean) + floor

    def concentrate(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(30):
            d = centres - mean
            order = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")
            before = np.cumsum(count[order]) - count[order]
            weight = np.zeros(len(count))
            weight[order] = np.clip((h - before) / count[order], 0, 1)
            new = fit(weight)
            if np.linalg.det(new[1]) >= np.linalg.det(cov) * (1 - 1e-9) and _:
                return mean, cov
            mean, cov = new
        return mean, cov

    def middle(x: np.ndarray, q: float = 0.5) -> float:
        order = np.argsort(x, kind="stable")
        return float(x[order][np.searchsorted(np.cumsum(count[order]), q * total)])

    median = np.array([middle(centres[:, k]) for k in range(P)])
    spread = np.array([1.4826 * middle(np.abs(centres[:, k] - median[k])) for k in range(P)])
    starts = [(median, np.diag(np.square(np.maximum(spread, FLOOR)))), fit(np.ones(len(count)))]
    rng = np.random.default_rng(7)
    for _ in range(8):
        weight = np.zeros(len(count))
        weight[rng.choice(len(count), size=min(len(count), P + 1), replace=False, p=count / total)] = 1
        starts.append(fit(weight))
    mean, cov = min((concentrate(*s) for s in starts), key=lambda s: np.linalg.det(s[1]))
    factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    return mean, factor * (cov - floor) + floor


def estimates(stats: DataFrame) -> DataFrame:
    """lang, source, mean, precision for each group with documents that pass the base rule."""
    xs = [F.least(x, F.lit(t)) for x, t in zip(transformed(), TOP)]
    rows = stats.where(~base_failed()).select("lang", "source", *[x.alias(f"x{k}") for k, x in enumerate(xs)])
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    grid = [f"q{k}" for k in range(P)]
    cells = rows.groupBy("lang", "source", *[F.floor(F.col(f"x{k}") / CELL[k]).alias(f"q{k}") for k in range(P)]).agg(
        F.count("*").alias("n"), *[F.sum(f"x{k}").alias(f"s{k}") for k in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in pairs]
    )
    totals = [x for x in cells.columns if x not in ("lang", "source", *grid)]
    # each cell counts for its group, its language and the corpus
    levels = F.array(*[F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), F.lit(None)), (F.lit(None), F.lit(None))])])
    pooled = cells.withColumn("l", F.explode(levels)).groupBy("l.level", "l.lang", "l.source", *grid).agg(*[F.sum(x).alias(x) for x in totals])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(grid)
        products = np.empty((len(pdf), P, P))
        for i, j in pairs:
            products[:, i, j] = products[:, j, i] = pdf[f"p{i}{j}"]
        mean, cov = mcd(pdf.n.to_numpy(float), pdf[[f"s{k}" for k in range(P)]].to_numpy(float), products)
        return pd.DataFrame({"level": [key[0]], "lang": [key[1]], "source": [key[2]], "n": [float(pdf.n.sum())], "mean": [mean.tolist()], "cov": [cov.ravel().tolist()]})

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                mean, cov = np.array(r.all_mean), np.array(r.all_cov)
                for n, m, c in ((r.lang_n, r.lang_mean, r.lang_cov), (r.own_n, r.own_mean, r.own_cov)):
                    mean, cov = drawn(n, np.array(m), np.array(c), mean, cov)
                out.append((r.lang, r.source, mean.tolist(), np.linalg.inv(cov.reshape(P, P)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["lang", "source", "mean", "precision"])

    e = cut(pooled.groupBy("level", "lang", "source").applyInPandas(fit, "level int, lang string, source string, n double, mean array<double>, cov array<double>"))
    of = lambda level, name: e.where(f"level = {level}").select("lang", "source", *[F.col(x).alias(f"{name}_{x}") for x in ("n", "mean", "cov")])
    groups, langs, corpus = of(0, "own"), of(1, "lang").drop("source").withColumnRenamed("lang", "e_lang"), of(2, "all").drop("lang", "source")
    found = groups.join(langs, groups.lang.eqNullSafe(langs.e_lang)).join(F.broadcast(corpus), F.lit(True))  # the corpus: one row
    return found.drop("e_lang").mapInPandas(combine, "lang string, source string, mean array<double>, precision array<double>")


def drawn(n: float, mean: np.ndarray, cov: np.ndarray, wide_mean: np.ndarray, wide_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate of n documents with ``PRIOR`` more that the wider estimate describes."""
    return (n * mean + PRIOR * wide_mean) / (n + PRIOR), (n * cov + PRIOR * wide_cov) / (n + PRIOR)


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed, distance and kept. stats is read twice: cut it first."""
    e = cut(estimates(stats)).select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), "mean", "precision")
    d = [x - F.get("mean", F.lit(k)) for k, x in enumerate(transformed())]
    distance = sum((d[i] * d[j] * F.get("precision", F.lit(i * P + j)) for i in range(P) for j in range(P)), F.lit(0.0))
    out = stats.join(e, stats.lang.eqNullSafe(e.e_lang) & stats.source.eqNullSafe(e.e_source), "left").withColumn("base_failed", base_failed()).withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).drop("e_lang", "e_source", "mean", "precision")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The statistics of each row of ``docs`` with base_failed, distance (null: no document of the group passes the base rule) and kept."""
    return judged(cut(statistics(docs)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; a row without doc_id stays."""
    return without_ids(docs, cut(quality_rules(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()))
