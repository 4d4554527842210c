"""Similar names: a fuzzy join with the optimal string alignment distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of

TOP = 3


def alignment_distance(a: str, b: str) -> int:
    """Edits that turn a into b: insert, delete, replace, or swap two neighbours (each piece once)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[len(b)]


#: Most edits that deletion keys are made for; names for which more are allowed meet by length.
KEYED = 3


def deletions(name: str, most: int) -> list[str]:
    """The name with up to ``most`` characters left out. Two names within k edits (swaps of neighbours included) have
    one of these in common, so a join on them finds every pair without comparing names with each other."""
    out = layer = {name}
    for _ in range(min(most, len(name))):
        layer = {x[:k] + x[k + 1 :] for x in layer for k in range(len(x))}
        out = out | layer
    return sorted(out)


def similar_names(wanted: DataFrame, vocabulary: DataFrame, top: int = TOP) -> DataFrame:
    """name, candidate, distance, rank: for each name of ``wanted`` (name) the nearest names of ``vocabulary`` (name,
    optionally preferred), at most a third of its length away and no farther than the nearest. Ties: anagrams first,
    then the same length, preferred names, the alphabet.

    Names with up to ``KEYED`` edits allowed (under 12 characters) meet candidates on deletion keys. Longer ones meet
    those of a possible length, and the native edit distance, at most twice the other, thins them out."""
    most = F.floor(F.greatest(F.length("name"), F.lit(3)) / 3).cast("int")
    left = wanted.select("name").where("name IS NOT NULL").distinct().select("name", most.alias("most"))
    has = "preferred" in vocabulary.columns
    right = vocabulary.where("name IS NOT NULL").groupBy(F.col("name").alias("candidate")).agg((F.max("preferred") if has else F.lit(False)).alias("preferred"))
    keys = udf_of(deletions, "array<string>")
    short = left.where(F.col("most") <= KEYED).select("*", F.explode(keys(F.col("name"), F.col("most"))).alias("key"))
    near = right.where(F.length("candidate") <= 4 * KEYED + 2).select("*", F.explode(keys(F.col("candidate"), F.lit(KEYED))).alias("key"))
    keyed = short.join(near, "key").select("name", "most", "candidate", "preferred").distinct()
    long = left.where(F.col("most") > KEYED).select("*", F.explode(F.sequence(F.length("name") - F.col("most"), F.length("name") + F.col("most"))).alias("length"))
    by_length = long.join(right.withColumn("length", F.length("candidate")), "length").where(F.levenshtein("name", "candidate") <= 2 * F.col("most"))
    pairs = keyed.unionByName(by_length.select("name", "most", "candidate", "preferred")).where("name <> candidate")
    pairs = pairs.withColumn("distance", udf_of(alignment_distance, "int")(F.col("name"), F.col("candidate"))).where("distance <= most")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    nearest = Window.partitionBy("name")
    order = nearest.orderBy(F.desc(letters("name") == letters("candidate")), F.desc(F.length("name") == F.length("candidate")), F.desc("preferred"), "candidate")
    best = pairs.withColumn("_least", F.min("distance").over(nearest)).where("distance = _least").withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= top).select("name", "candidate", "distance", "rank")


def package_closure(includes: DataFrame, packages: DataFrame, rounds: int = 100) -> DataFrame:
    """package, member: what each package of ``packages`` (package) includes at any depth, itself included.
    includes: (package, include), which may have cycles: each round joins only what is new."""
    from lectern.sources.session import cut

    seen = packages.select("package", F.col("package").alias("member")).distinct()
    new = seen
    edges = includes.select(F.col("package").alias("member"), F.col("include"))
    for _ in range(rounds):
        new = new.join(edges, "member").select("package", F.col("include").alias("member")).distinct()
        new = cut(new.join(seen, ["package", "member"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))
    raise RuntimeError(f"more than {rounds} levels of packages")
