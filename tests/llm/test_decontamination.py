import random

import numpy as np
import pytest

from conftest_llm import plain_match
from conftest_llm_words import words
from lectern.llm import decontamination as d

BENCH = "item_id long, text string"
QUESTION = "When Anna Berg buys 5 green apples for 3 dollars and sells 12 of them at the market, how much money does Anna Berg keep after 4 days of work?"


def plain_contains(text: str, item: str) -> bool:
    """Brute force: whether all words of an item stand in the text, one after the other."""
    t, i = text.split(), item.split()
    return any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(11)
    return [(k, words(rng, rng.randint(15, 60))) for k in range(30)] + [(30, QUESTION)]


def test_passages_are_found_and_clean_documents_left(spark, bench):
    rng = random.Random(12)
    rows = []
    for k in range(200):
        body = words(rng, rng.randint(20, 400)).split()
        if k % 4 == 0:
            at = rng.randrange(len(body))
            body[at:at] = bench[rng.randrange(30)][1].split()
        rows.append((k, " ".join(body)))
    want = {(i, j) for i, t in rows for j, b in bench if plain_contains(t, b)}
    assert len({i for i, _ in want}) == 50
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, BENCH)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()} == want
    assert {r.doc_id for r in d.keep_clean(docs, items).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def found(spark, items: list[str], texts: list[str]) -> list[bool]:
    """Of each pair, whether the text is found to hold the item."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = d.contaminated(docs, spark.createDataFrame(list(enumerate(items)), BENCH)).collect()
    return [(k, k) in {(r.doc_id, r.item_id) for r in got} for k in range(len(texts))]


EXCHANGED = [
    ("x " + QUESTION + " y", True),
    (QUESTION.replace("Anna Berg", "Tom Lee").replace("5", "7").replace("12", "31").replace("dollars", "euros"), True),
    (QUESTION.replace("Anna Berg buys", "Tom Lee buys").replace("Anna Berg keep", "Sue keep").replace("5", "9").replace("12", "1"), False),  # one name became two
    ("When it rains, people buy green apples for a few dollars and keep money after days of work", False),
    ("", False),
]


def test_exchanged_figures_and_names(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(EXCHANGED)], "doc_id long, text string")
    got = {r.doc_id for r in d.contaminated(docs, spark.createDataFrame([(1, QUESTION)], BENCH)).collect()}
    assert [k in got for k in range(len(EXCHANGED))] == [f for _, f in EXCHANGED]


LIST = "Anna Berg, Tom Lee, Sue Ray and Max Orr: 5, 12, 31, 40, 52"


CASES = [
    (QUESTION, "x " + QUESTION.upper() + " y", True),
    (QUESTION, "x " + QUESTION.lower() + " y", True),
    (QUESTION.upper(), "x " + QUESTION + " y", True),
    (QUESTION, QUESTION.replace("Anna Berg", "Tom Lee").replace("5", "7").upper(), True),
    (QUESTION, QUESTION.replace("Anna Berg", "Tom Lee").replace("5", "7").lower(), True),
    (QUESTION, QUESTION.replace("Anna Berg buys", "Tom Lee buys").replace("Anna Berg keep", "Sue keep").replace("5", "9").replace("12", "1").upper(), False),
    (LIST, "so " + LIST + " or", True),
    (LIST, "so " + LIST.replace("Anna Berg", "Ann Lee").replace("12, 31", "8, 9") + " or", False),
]


@pytest.mark.parametrize("item, text, want", CASES)
def test_case_alone_decides_nothing(spark, item, text, want):
    assert found(spark, [item], [text]) == [want]


def test_exchanged_slots_match_brute_force(spark):
    rng = random.Random(21)
    names, units = ["Anna", "Tom Lee", "Sue Ray", "Bo", "Max"], ["dollars", "km", "days", "euros"]
    small = [w for w in words(rng, 300).lower().replace(".", "").split()][:40]

    def question() -> list[str]:
        out = []
        for _ in range(rng.randint(1, 40)):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.12 else f"{rng.randint(1, 60)} {rng.choice(units)}" if x < 0.24 else str(rng.randint(1, 9)) if x < 0.3 else rng.choice(small))
        return " ".join(out).split()

    def changed(q: list[str]) -> list[str]:
        swap, kind = dict(zip(("Anna", "Tom", "Lee", "Bo"), rng.sample(["Eva", "Kim", "Jon", "Ute", "Pat"], 4))), rng.randrange(6)
        if kind == 0:
            return q
        if kind < 3:
            q = [swap.get(w, str(int(w) + 1) if w.isdigit() else w) for w in q]
        if kind == 2:
            q = [rng.choice(["Zoe", "Ida"]) if w[0].isupper() else w for w in q]  # no longer consistent
        if kind == 3:
            q = [w for w in q if rng.random() > 0.1]
        if kind == 4:
            q = [w.upper() for w in q]
        return q[: len(q) // 2] if kind == 5 else q

    items = [" ".join(question()) for _ in range(40)]
    texts = []
    for k in range(120):
        body = [rng.choice(small) for _ in range(rng.randint(0, 60))]
        body[rng.randint(0, len(body)) :][:0] = []
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + changed(items[rng.randrange(40)].split()) + body[at:] + (changed(items[rng.randrange(40)].split()) if k % 3 == 0 else [])))
    lower = {c.casefold() for t in items for w in t.split() if (c := w.strip(d.MARKS)) and not c[0].isdigit() and not c[0].isupper()}
    want = {(k, j) for k, t in enumerate(texts) for j, i in enumerate(items) if plain_match(t, i, lower)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first = {i: min(j for j, x in enumerate(items) if x == i) for i in items}
    want = {(k, first[items[j]]) for k, j in want}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, spark.createDataFrame(list(enumerate(items)), BENCH)).collect()}
    assert got == want and 60 < len(want)


def test_bands_are_the_same_one_by_one(monkeypatch):
    rng = random.Random(8)
    shared = [d.Shared(np.array(sorted(rng.sample(range(200), rng.randint(1, 9)))), None, np.array(sorted(rng.sample(range(60), rng.randint(1, 5))))) for _ in range(12)]
    shared[3].fills = np.arange(5 * len(shared[3].at), dtype=np.uint64).reshape(-1, 5)
    rows = lambda: [sorted((int(p), int(q), *map(int, f)) for p, q, f in zip(*b)) for b in d.bands(shared, 3)]
    at_once = rows()
    monkeypatch.setattr(d, "PAIRS", 0)
    assert rows() == at_once and len(at_once) > 5


def test_result_does_not_depend_on_what_is_broadcast(spark, bench, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(bench)] * 3, "doc_id long, text string")
    items = spark.createDataFrame(bench, BENCH)
    one = sorted(d.contaminated(docs, items).collect())
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(d, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(d, "MAX_BITS", d.LEAST_BITS)
    assert sorted(d.contaminated(docs.repartition(5), items.repartition(4)).collect()) == one and len(one) == 93


def test_equal_items_count_once(spark):
    items = spark.createDataFrame([(9, QUESTION), (4, QUESTION.replace(" ", "  ")), (None, QUESTION + "\n"), (5, "too short")], BENCH)
    docs = spark.createDataFrame([(1, QUESTION), (2, "That is far Too, short!"), (3, "too long short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()) == [(1, 4), (2, 5)]


def test_very_common_words_and_long_repeats(spark):
    docs = spark.createDataFrame([(1, "tin " * 30_000), (2, "tin the " * 2000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tin " * 40), (2, "the tin " * 10), (3, "the the the the the tin")], BENCH)
    assert sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()) == [(1, 1), (2, 2)]


def test_odd_rows(spark, odd, none, bench):
    items = spark.createDataFrame([*bench, (None, None), (77, ""), (78, "one")], BENCH).selectExpr("*", "'z' AS doc_id")
    assert [(r.doc_id, r.item_id) for r in d.contaminated(odd, items).collect()] == [(5, 78), (5, 78)]
    assert sorted(d.keep_clean(odd, items).collect(), key=str) == sorted(odd.where("doc_id IS NULL OR doc_id <> 5").collect(), key=str)
    empty = spark.createDataFrame([], BENCH)
    assert d.contaminated(odd, empty).count() == 0 and d.contaminated(none, items).count() == 0
    twice = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (None, QUESTION)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in d.contaminated(twice, items).collect()) == ["1", "1", "None"]
