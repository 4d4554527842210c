import random

from conftest_llm_words import words
from lectern.llm import license_scan as s


def test_settings_hold_what_they_promise():
    """The least Jaccard similarity of a window that holds CONTAINED of a template, for every class; and the collisions at it."""
    for group in s.classes():
        shortest, longest = (f(len(w) for _, _, w in group) for f in (min, max))
        n = min(s.SHINGLE, shortest)
        window = longest + s.stride_of(shortest) - 1 - n + 1
        for _, _, w in group:
            size = len(s.shingles_of(w))
            held = -(-s.CONTAINED * size // 1)
            assert held / (window + size - held) >= s.LEAST_JACCARD, (shortest, longest)
    assert 1 - (1 - s.LEAST_JACCARD**s.ROWS) ** s.BANDS > 0.9999


def test_anchors_lose_nothing():
    every = [s.shingles_of(w) for g in s.classes() for _, _, w in g]
    words_ = set(s.anchors(every))
    for shingles in every:
        assert sum(not words_ & set(x.split()) for x in shingles) < s.CONTAINED * len(shingles)


def brute(text, templates=s.TEMPLATES):
    """Templates of which some window of any length holds CONTAINED of the shingles."""
    w, out = s.python_words(text or ""), set()
    for k, (_, t) in enumerate(templates):
        mine = s.python_words(t)
        n, size = min(s.SHINGLE, len(mine)), len(mine)
        wanted = set(s.shingles_of(mine))
        got = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
        best = max((len(wanted & set(got[i : i + size - n + 1])) for i in range(len(got))), default=0)
        if best >= s.CONTAINED * len(wanted):
            out.add(k)
    return out


def test_scan_matches_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for k in range(120):
        body = words(rng, rng.randint(0, 150)).split()
        if k % 2:
            notice = s.TEMPLATES[rng.randrange(len(s.TEMPLATES))][1].split()
            if k % 6 == 1 and len(notice) > 20:
                notice[len(notice) // 2] = "changed"
            if k % 6 == 3:
                notice = [x.upper() for x in notice]
            at = rng.randint(0, len(body))
            body[at:at] = notice
        rows.append((k, " ".join(body)))
    got = {}
    for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.containment >= s.CONTAINED
        got.setdefault(r.doc_id, set()).add(r.template)
    for k, t in rows:
        want = brute(t)
        assert got.get(k, set()) == want, t
    assert sum(map(len, got.values())) >= 60


def test_only_the_same_passage_is_suppressed(spark):
    text = {name: t for name, t in s.TEMPLATES}
    bsd = "All rights reserved. " + text["BSD"].rsplit(" ", 1)[0] + " kept"
    versions = text["GPL-3.0"] + " one two three four five six " + text["GPL-2.0"].replace("This", "Our", 1)
    rows = [(1, "x y z " + bsd), (2, versions), (3, "x " + text["GPL-3.0"]), (4, " ".join([text["GPL-3.0"] + " and"] * 300 + [text["GPL-2.0"]]))]
    got, hidden = {}, {}
    for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        (hidden if r.in_fuller else got).setdefault(r.doc_id, {})[r.license] = r.containment
    assert "GPL-2.0" in hidden[3] and hidden[3]["GPL-2.0"] < got[3]["GPL-3.0"] == 1  # returned, but told apart
    assert {k: set(x) for k, x in got.items()} == {1: {"all-rights-reserved", "BSD"}, 2: {"GPL-3.0", "GPL-2.0"}, 3: {"GPL-3.0"}, 4: {"GPL-3.0", "GPL-2.0"}}
    assert got[1]["BSD"] < 1 and got[2]["GPL-2.0"] < 1 and got[4]["GPL-2.0"] == 1


def test_odd_rows(spark, odd, none):
    assert s.scan(odd).count() == 0 and s.scan(none).count() == 0
    again = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x All rights reserved. y"), (2, "rights")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.license, r.containment) for r in s.scan(again).where("NOT in_fuller").collect()) == [("1", "MIT", 1.0), ("None", "all-rights-reserved", 1.0)]
