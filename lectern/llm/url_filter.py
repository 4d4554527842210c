"""URL filters: rules, then gradient-boosted trees on lexical features (operator 10). DataFrame functions only.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains if the URL's path starts with
its own, and the longest that fits decides. URLs that no rule fits are judged by trees boosted on lexical features:
lengths, depth, digit ratios, entropy, parameters and statistics of the host's suffix. The trees are trained on a labelled
set (url, blocked) that is kept apart from the table they judge: the caller's, or without one that of ``sample_urls``.

Rules are a short list in the query's code, so they are literals of one expression. Features of at most ``TRAIN_ROWS``
different labelled URLs (the first by hash of the URL, so the same at any partitioning), each weighed by its copies, are
numbers from 0 to ``BINS`` - 1; equal rows are counted once, and these cells, as many as URLs at most, come to the driver
in one job, where trees with logistic loss are boosted on their exact histograms. The finished trees are CASE
expressions, so scoring is one projection inside the scan's stage.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored like any
other. Repeated rows are judged alike, a very long URL whole, in time about proportional to its length; an empty table
gives no rows, and columns beside page_id and url don't matter, whatever their names. Without labelled URLs, or with one
class only, all scores are the prior's: allowed where there are none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.sample_urls import labelled_urls

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TRAIN_ROWS = 4000
TREES = 24
DEPTH = 3
RATE = 0.3
#: Bins of each feature, least weight of a leaf, and the penalty on a leaf's square.
BINS = 16
LEAST_HESSIAN = 1.0
PENALTY = 1.0
CUT = 0.5


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(host: str, path: str) -> str:
    return host + path


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """rule, verdict of the longest rule that fits (null: none)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, rule_name(h, p)).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def entropy(s: Column) -> Column:
    """Of a string's characters, in bits: the lengths of the runs of its characters in order."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    part = lambda run: F.when(run > 0, -run / n * F.log2(run / n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("c"), F.when(a.c == c, a.run + 1).otherwise(F.lit(1.0)).alias("run"), F.when(a.c == c, a.sum).otherwise(a.sum + part(a.run)).alias("sum"))
    return F.aggregate(chars, start, step, lambda a: a.sum + part(a.run))


def binned(x: Column, width: float) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x / width))).cast("int")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """name → number from 0 to BINS - 1."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.size(F.split(host, r"\."))
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    ratio = lambda s, chars: count(s, chars) / F.greatest(F.length(s), F.lit(1))
    digits = "0123456789"
    return {
        "url_length": binned(F.length(url), 8),
        "host_length": binned(F.length(host), 3),
        "path_length": binned(F.length(path), 4),
        "depth": binned(count(path, "/"), 1),
        "host_labels": binned(labels, 1),
        "host_hyphens": binned(count(host, "-"), 1),
        "digit_ratio": binned(ratio(url, digits), 0.04),
        "host_digit_ratio": binned(ratio(host, digits), 0.04),
        "host_entropy": binned(entropy(host), 0.3),
        "path_entropy": binned(entropy(path), 0.3),
        "parameters": binned(F.when(query == "", 0).otherwise(1 + count(query, "&")), 1),
        "query_length": binned(F.length(query), 5),
        "secure": F.when(F.lower(F.substring(url, 1, 6)) == "https:", 1).otherwise(0),
    }


@dataclass
class Model:
    """prior: log odds; trees: {node: (feature, bin) or value}, node k's children are 2k + 1 (bin and below) and 2k + 2."""

    prior: float
    trees: list[dict[int, tuple[str, int] | float]]
    suffix_bin: dict[str, int]
    default_bin: int

    def suffix(self, host: Column) -> Column:
        """The blocked share of a host's suffix among the labelled URLs, binned; unknown suffixes: of all."""
        if not self.suffix_bin:
            return F.lit(self.default_bin)
        known = F.create_map(*[x for s, b in sorted(self.suffix_bin.items()) for x in (F.lit(s), F.lit(b))])
        return F.coalesce(F.element_at(known, suffix_of(host)), F.lit(self.default_bin))

    def score(self, columns: dict[str, Column]) -> Column:
        """Probability that a URL is to be blocked. columns: as in ``features``, with suffix."""

        def walk(tree: dict, node: int) -> Column:
            at = tree[node]
            if isinstance(at, float):
                return F.lit(at)
            return F.when(columns[at[0]] <= at[1], walk(tree, 2 * node + 1)).otherwise(walk(tree, 2 * node + 2))

        z = reduce(lambda a, t: a + walk(t, 0), self.trees, F.lit(self.prior))
        return 1 / (1 + F.exp(-z))


def share_bin(blocked: int, n: int) -> int:
    return min(BINS - 1, int(BINS * (blocked + 1) / (n + 2)))


def best_split(rows: list[tuple[tuple[int, ...], float, float]], names: list[str]) -> tuple[str, int] | float:
    """The split with most gain, or the leaf's value if none gains. rows: (bins, gradient, hessian)."""
    total_g, total_h = math.fsum(r[1] for r in rows), math.fsum(r[2] for r in rows)
    worth = lambda g, h: g * g / (h + PENALTY)
    best, most = None, 1e-6
    for f, name in enumerate(names):
        by: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for bins, g, h in rows:
            at = by[bins[f]]
            at[0] += g
            at[1] += h
        g = h = 0.0
        for b in sorted(by)[:-1]:
            g, h = g + by[b][0], h + by[b][1]
            gain = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
            if min(h, total_h - h) >= LEAST_HESSIAN and gain > most + 1e-9:
                best, most = (name, b), gain
    return best or leaf(rows)


def leaf(rows: list) -> float:
    return -RATE * math.fsum(r[1] for r in rows) / (math.fsum(r[2] for r in rows) + PENALTY)


def grow(rows: list, names: list[str], depth: int, node: int = 0) -> dict[int, tuple[str, int] | float]:
    """A tree over rows of (bins, gradient, hessian)."""
    at = best_split(rows, names) if depth else leaf(rows)
    if isinstance(at, float):
        return {node: at}
    f = names.index(at[0])
    low, high = [r for r in rows if r[0][f] <= at[1]], [r for r in rows if r[0][f] > at[1]]
    return {node: at, **grow(low, names, depth - 1, 2 * node + 1), **grow(high, names, depth - 1, 2 * node + 2)}


def value_of(tree: dict, bins: dict[str, int], node: int = 0) -> float:
    while not isinstance(tree[node], float):
        name, b = tree[node]
        node = 2 * node + (1 if bins[name] <= b else 2)
    return tree[node]


def fit(labelled: DataFrame, limit: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boost on at most ``limit`` different URLs of ``labelled`` (url, blocked), weighed by their rows; null URLs and labels
    are left out."""
    rows = labelled.select("url", F.col("blocked").cast("int").alias("y")).where("url IS NOT NULL AND y IN (0, 1)")
    rows = rows.groupBy("url").agg(F.count("*").alias("n"), F.sum("y").alias("blocked")).orderBy(F.xxhash64("url"), "url").limit(limit)
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("n", "blocked", suffix_of(F.col("host")).alias("suffix_name"), *[c.alias(k) for k, c in features(F.col("url"), F.col("host"), F.col("path")).items()])
    names = [c for c in rows.columns if c not in ("n", "blocked", "suffix_name")]
    cells = rows.groupBy("suffix_name", *names).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).collect()  # limit at most
    cells.sort(key=lambda r: (r.suffix_name, *[r[k] for k in names]))
    n, blocked = sum(r.n for r in cells), sum(r.blocked for r in cells)
    if not 0 < blocked < n:
        return Model(-60.0 if blocked == 0 else 60.0, [], {}, 0)
    by_suffix: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in cells:
        by_suffix[r.suffix_name][0] += r.blocked
        by_suffix[r.suffix_name][1] += r.n
    model = Model(math.log(blocked / (n - blocked)), [], {s: share_bin(*x) for s, x in by_suffix.items()}, share_bin(blocked, n))
    names.append("suffix")
    bins = [{**{k: r[k] for k in names[:-1]}, "suffix": model.suffix_bin[r.suffix_name]} for r in cells]
    keys, z = [tuple(b[k] for k in names) for b in bins], [model.prior] * len(cells)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-x)) for x in z]
        tree = grow([(key, r.n * q - r.blocked, r.n * q * (1 - q)) for key, r, q in zip(keys, cells, p)], names, depth)
        z = [x + value_of(tree, b) for x, b in zip(z, bins)]
        model.trees.append(tree)
    return model


def filtered(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict for each row of ``pages`` (page_id, url).

    labelled: (url, blocked); None: a made-up set."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    model = fit(labelled_urls(pages.sparkSession, TRAIN_ROWS) if labelled is None else labelled)
    scored = rows.withColumns(features(F.col("url"), F.col("host"), F.col("path"))).withColumn("suffix", model.suffix(F.col("host")))
    names = [*features(F.lit(""), F.lit(""), F.lit("")), "suffix"]
    score = model.score({k: F.col(k) for k in names})
    out = scored.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.col("score") > CUT, "block").otherwise("allow")).alias("verdict"))
