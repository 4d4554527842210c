"""Made-up labelled URLs that the URL filter's trees are trained on: ordinary pages, and pages of link farms, traps and
trackers. DataFrame functions only; each choice is a hash of the row's number, so the set is the same everywhere.

Neither kind is told by a list of words: hosts are made of syllables, and what differs is the shape (hyphens and digits in
hosts, numbers for hosts, long names, many parameters, deep paths, endings that such pages favour). One in ten of either
kind has the looks of the other in all but one respect, and both share endings, so no single feature decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = tuple("an ar bel cor da den el fi gar ho in jo ka len ma nor or pa qui ra sel ta ul ver wy zan".split())
PLAIN_ENDINGS = tuple("com com com org org net net edu gov de fr es it uk io info".split())
OTHER_ENDINGS = tuple("xyz top click loan win icu buzz info biz com net online".split())
PARTS = ("", "", "www.", "www.", "blog.", "news.", "m.", "docs.", "shop.")
SECTIONS = tuple("en de fr es news about articles wiki docs products topics archive".split())
PLAIN_QUERIES = ("", "", "", "", "?page=2", "?page=2&ref=x", "?utm_source=feed", "#top", "?id=17", "?lang=en", "?q=den")
NAMES = ("aff", "sid", "click", "ref", "cid", "redir", "token", "src", "sub", "go")


def pick(salt: int, *choices: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), number(salt, len(choices)) + 1)


def number(salt: int, n: int) -> Column:
    """From 0 to n - 1, by the row's number."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")


def word(salt: int, syllables: int) -> Column:
    return F.concat(*[pick(salt * 100 + k, *SYLLABLES) for k in range(syllables)])


def words(salt: int, n: int, between: str) -> Column:
    return F.concat_ws(between, *[word(salt + k, 2) for k in range(n)])


def noise(salt: int, n: int) -> Column:
    return F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{salt}")), 256), 1, n)


def labelled_urls(spark: SparkSession, n: int) -> DataFrame:
    """url, blocked of n made-up URLs, half of each kind."""
    digits = lambda salt, most: number(salt, most).cast("string")
    plain_host = F.concat(pick(1, *PARTS), pick(2, word(3, 2), word(4, 3), word(5, 3), words(6, 2, "-"), word(8, 4)), F.lit("."), pick(9, *PLAIN_ENDINGS))
    plain_path = pick(
        10,
        F.concat(F.lit("/"), pick(11, *SECTIONS), F.lit("/"), digits(12, 1000), pick(13, "", "/", ".html")),
        F.concat(F.lit("/"), pick(14, *SECTIONS), F.lit("/"), words(15, 3, "-"), pick(18, "", "/", ".html")),
        F.concat(F.lit("/"), words(19, 2, "/")),
        F.concat(F.lit("/2"), F.lpad(digits(21, 30), 3, "0"), F.lit("/"), digits(22, 12), F.lit("/"), words(23, 4, "-")),
        F.lit("/"),
        F.lit(""),
    )
    bad_host = pick(
        30,
        F.concat(words(31, 3, "-"), digits(34, 10000), F.lit("."), pick(35, *OTHER_ENDINGS)),
        F.concat(words(36, 4, "-"), F.lit("."), pick(40, *OTHER_ENDINGS)),
        F.concat(noise(41, 12), F.lit("."), pick(42, *OTHER_ENDINGS)),
        F.concat(noise(43, 6), F.lit("."), word(44, 3), digits(45, 100), F.lit("."), pick(46, *OTHER_ENDINGS)),
        F.concat_ws(".", *[digits(47 + k, 256) for k in range(4)]),
        F.concat(F.lit("secure."), F.lit("login."), words(51, 2, "-"), F.lit("."), word(53, 3), F.lit("."), pick(54, *OTHER_ENDINGS)),
    )
    bad_path = pick(55, F.concat(F.lit("/"), noise(56, 16)), F.concat_ws("/", F.lit(""), *[noise(57 + k, 5) for k in range(5)]), F.concat(F.lit("/"), word(62, 2), F.lit(".php")), F.lit("/"))
    parameters = reduce(lambda a, k: F.concat(a, F.lit("&"), pick(64 + k, *NAMES), F.lit("="), noise(70 + k, 8)), range(3), F.concat(F.lit("?"), pick(63, *NAMES), F.lit("="), digits(69, 100000)))
    bad_query = pick(75, parameters, parameters, F.concat(F.lit("?"), pick(76, *NAMES), F.lit("="), noise(77, 20)), F.lit(""))
    blocked, odd = F.col("id") % 2 == 1, number(80, 10) == 0
    host = F.when(blocked & ~(odd & (number(81, 2) == 0)), bad_host).otherwise(plain_host)
    path = F.when(blocked & ~(odd & (number(81, 2) == 1)), bad_path).when(odd, F.concat(plain_path, F.lit("/"), words(82, 5, "-"))).otherwise(plain_path)
    query = F.when(blocked & ~(odd & (number(81, 2) == 1)), bad_query).otherwise(pick(90, *PLAIN_QUERIES))
    scheme = F.when(blocked, pick(91, "http", "http", "https")).otherwise(pick(92, "http", "https", "https"))
    return spark.range(n).select(F.concat(scheme, F.lit("://"), host, path, query).alias("url"), blocked.cast("int").alias("blocked"))
