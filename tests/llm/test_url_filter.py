import math
import re

import pytest

from lectern.llm import url_filter as u
from lectern.llm.sample_urls import labelled_urls

PAGE = "page_id long, url string"


def plain(url):
    """(host, path, rule) by string operations."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://NET", "https://a.NET/x?y#z", "http://a.net?x", "http://example.net/en/", "http://sub.example.net/en/1", "http://example.net/EN/", "http://notexample.net/en/",
    "http://example.com/de/1?u=http://example.net/en/", "http://badexample.com/de/", "http://x.org/fr/a#b", "http://org/fr/", "ftp://x.org/fr", "//x.org/fr/", "http://ÄB.org/fr/é", "http://a.b.c/d/e/f?g=1&h=2", "x\n://y.net/z",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = list(enumerate(URLS))
    rows += [(100 + k, f"http://{'spam-offers' if k % 5 == 0 else 'quiet'}{k}.example.org/en/{k}") for k in range(300)]
    return spark.createDataFrame(rows, PAGE)


def test_rules_match_brute_force(pages):
    got = {r.page_id: r for r in u.filtered(pages).collect()}
    for k, url in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == plain(url), url
    verdict = {h + p: v for h, p, v in u.RULES}
    assert all(r.verdict == verdict[r.rule] for r in got.values() if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_trees_learn_from_labels(spark, pages):
    rows = [(f"http://{'spam-x' if k % 3 == 0 else 'fine'}{k}.example.org/en/{k}", int(k % 3 == 0)) for k in range(400)]
    got = u.filtered(pages, spark.createDataFrame(rows, "url string, blocked int")).collect()
    for r in got:
        if r.page_id >= 100:
            assert r.verdict == ("block" if "spam" in r.host else "allow")


def test_model_is_the_same_at_any_partitioning(pages):
    one = {r.page_id: r.score for r in u.filtered(pages.repartition(1)).collect()}
    assert {r.page_id: r.score for r in u.filtered(pages.repartition(7)).collect()} == pytest.approx(one)


def test_copies_of_urls_leave_room_for_others(spark):
    urls = [(f"http://{'spam-x' if k % 2 else 'fine'}{k}.example.org/en/{k}", k % 2) for k in range(20)]
    labelled = spark.createDataFrame([x for x in urls for _ in range(30 + 60 * x[1])], "url string, blocked int")
    model = u.fit(labelled, limit=20, trees=1, depth=1)
    assert model.prior == pytest.approx(math.log(3)) and len(model.trees) == 1


def test_held_out_urls_are_told_apart(spark):
    rows = labelled_urls(spark, 6000).collect()
    train, held = rows[:4000], [r for r in rows[4000:] if r not in set(rows[:4000])]
    pages = spark.createDataFrame([(k, r.url) for k, r in enumerate(held)], PAGE)
    got = u.filtered(pages, spark.createDataFrame(train), rules=()).collect()
    right = [(r.verdict == "block") == bool(held[r.page_id].blocked) for r in got]
    assert len(right) > 1500 and sum(right) >= 0.95 * len(right)


def test_scores_match_a_plain_version(spark, pages):
    labelled = labelled_urls(spark, 1000)
    model = u.fit(labelled, trees=5)
    names = [*u.features(u.F.lit(""), u.F.lit(""), u.F.lit(""))]
    rows = pages.select("page_id", "url", u.host_of(u.F.col("url")).alias("host"), u.path_of(u.F.col("url")).alias("path"))
    rows = {r.page_id: r for r in rows.select("page_id", "host", *[c.alias(k) for k, c in u.features(u.F.col("url"), u.F.col("host"), u.F.col("path")).items()]).collect()}
    score = model.score({k: u.F.col(k) for k in names} | {"suffix": model.suffix(u.F.col("h"))})
    flat = spark.createDataFrame([(k, r.host, *[r[n] for n in names]) for k, r in rows.items()], ["page_id", "h", *names])
    for r in flat.select("page_id", score.alias("score")).collect():
        one = rows[r.page_id]
        bins = {n: one[n] for n in names} | {"suffix": model.suffix_bin.get(one.host.rpartition(".")[2], model.default_bin)}
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.prior - sum(u.value_of(t, bins) for t in model.trees))))


@pytest.mark.parametrize("text", ["", "a", "aaaa", "abcd", "example.net", "ab" * 5000])
def test_entropy_matches_brute_force(spark, text):
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert spark.range(1).select(u.entropy(u.F.lit(text))).first()[0] == pytest.approx(want)


def test_all_suffixes_count(spark):
    rows = [(f"http://host.s{k}/", k % 2) for k in range(500)]
    model = u.fit(spark.createDataFrame(rows, "url string, blocked int"), trees=1)
    assert len(model.suffix_bin) == 500


def test_odd_rows(spark):
    none = spark.createDataFrame([], PAGE)
    assert u.filtered(none).count() == 0
    odd = spark.createDataFrame([(None, None, "c"), (1, "x" * 100_000, "c"), (1, "http://a.org/", "c"), (1, "http://a.org/", "c")], PAGE + ", host string")
    got = u.filtered(odd).collect()
    assert len(got) == 4 and all(r.verdict == "allow" for r in got)
    only = spark.createDataFrame([("http://a.org", 1)], "url string, blocked int")
    assert {r.verdict for r in u.filtered(odd, only).collect()} == {"block"}


def test_no_python_in_the_plan(pages):
    plan = u.filtered(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["quality_statistics", "url_rules"])
def test_sql_gives_the_same(spark, name):
    import duckdb

    from lectern.llm import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
