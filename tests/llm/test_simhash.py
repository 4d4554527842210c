import random

import xxhash
from conftest_llm import brute_components

from lectern.llm import simhash_dedup as s


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    if not shingles:
        return 0
    counts = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprint_is_the_majority():
    rng = random.Random(1)
    for text in (None, "", "One", "One TWO", "One two three", " ".join(rng.choice("ABCDÄé") for _ in range(300))):
        assert s.simhash(text) & s.ALL == plain_fingerprint(text)


def test_covering_finds_every_pair_within_the_radius():
    rng = random.Random(2)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        diff = sum(1 << b for b in bits)
        assert any(not diff & m for m in s.FIRST)
    assert s.MAX_OPEN < 20


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(rng.randint(0, 4)):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            prints.append(p)
    prints += prints[:5]
    rows = [(k, s.signed(p)) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "id long, fp long").groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "rep")
    want = brute_components({k: p for k, p in enumerate(prints)})
    for bucket in (4096, 2):  # with small buckets the finer families are used
        found = s.components(s.links(nodes, bucket=bucket))
        names = {r.node: r.component for r in found.collect()}
        rep = {r.fp: r.rep for r in nodes.collect()}
        assert {k: names.get(rep[fp], rep[fp]) for k, fp in rows} == want


def test_odd_rows(spark, odd, none):
    got = s.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[None].component_id is None and by[5].component_id == 5
    kept = s.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 5, 6, 7]
    assert s.near_duplicates(none).count() == 0 and s.deduplicate(none).count() == 0
