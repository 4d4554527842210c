import math
import random
import zlib

import numpy as np
import pytest

from conftest_llm_texts import labelled_texts
from lectern.llm import quality_classifier as quality
from lectern.llm import toxicity
from lectern.llm.common import training_rows

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = labelled_texts(random.Random(8), 600)
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(corpus, module, label):
    docs, labels = corpus
    want = {r.doc_id: r[label] for r in labels.collect()}
    got = module.classify(docs, docs, labels).collect()
    assert len(got) == len(want)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in want if zlib.crc32(str(d).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.CUT) for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_labels_of_the_held_out_fold_change_nothing(spark, corpus, module, label):
    docs, labels = corpus
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality, 1 - r.toxic) if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else tuple(r) for r in labels.collect()], LABELS)
    one, two = ({r.doc_id: r.score for r in module.classify(docs, docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_unseen_misspellings_share_ngrams(corpus):
    docs, labels = corpus
    model = toxicity.fit([(r.text, r.toxic) for r in docs.join(labels, "doc_id").select("text", "toxic").collect()])
    logits = toxicity.Logits(model)
    assert toxicity.score("grubbleworst " * 5 + "the table", logits) > toxicity.score("the house table", logits)


def test_the_worst_stretch_decides_wherever_it_stands(corpus):
    """Against a plain loop over all stretches, and an insult at any place of a long text."""
    docs, labels = corpus
    model = toxicity.fit([(r.text, r.toxic) for r in docs.join(labels, "doc_id").select("text", "toxic").collect()])
    logits = toxicity.Logits(model)
    rng = random.Random(6)
    for n in (1, 5, 299, 300, 301, 374, 375, 376, 1000):
        words = [rng.choice(["the", "house", "grubbleworm", "river", "snorkhead"]) for _ in range(n)]
        z = [float(model.rows[b].mean()) for w in words for _, b in [toxicity.subwords([w])]]
        found, end = [], toxicity.STRETCH
        while True:
            part = z[max(0, min(end, n) - toxicity.STRETCH) : min(end, n)]
            found.append(sum(part) / (len(part) + toxicity.PAD))
            if end >= n:
                break
            end += toxicity.STEP
        assert toxicity.score(" ".join(words), logits) == pytest.approx(1 / (1 + math.exp(-(model.bias + max(found)))), rel=1e-6), n
    insult = "grubbleworm snorkhead vilefritz " * 60
    scores = [toxicity.score("the house " * k + insult + "the river " * (2000 - k), logits) for k in range(0, 2000, 37)]
    assert min(scores) > 0.5 and max(scores) - min(scores) < 0.2


@pytest.mark.parametrize("n", [64, 65, 66, 68, 69, 124, 125, 128, 129, 1000])
def test_pieces_of_long_words_lose_no_ngram(monkeypatch, n):
    rng = random.Random(n)
    w = "".join(rng.choice("abcdefghij_你好") for _ in range(n - 2))
    text = f"short *a{w}b, {w[:5]}"
    pieces = toxicity.words_of(text)
    found = set(toxicity.subwords(pieces)[1].tolist())
    monkeypatch.setattr(toxicity, "LONGEST", 10**6)
    assert toxicity.words_of(text) == text.split() and set(toxicity.subwords(text.split())[1].tolist()) == found
    assert len(pieces) == 2 + max(1, -(-(n - 4) // 60))


def test_long_words_count_whole(corpus):
    docs, labels = corpus
    model = toxicity.fit([(r.text, r.toxic) for r in docs.join(labels, "doc_id").select("text", "toxic").collect()])
    logits = toxicity.Logits(model)
    clean, toxic = "the_house_walks_under_" * 5, "grubbleworm_snorkhead_vilefritz_" * 40
    assert toxicity.score(clean, logits) < toxicity.CUT <= toxicity.score(clean + toxic, logits)


@pytest.mark.parametrize("module, empty", [(quality, 1.0), (toxicity, 0.0)])
def test_odd_rows(spark, odd, none, corpus, module, empty):
    labels = corpus[1].selectExpr("*").union(spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 0, 1), (5, 1, 0)], LABELS))
    got = module.classify(odd, corpus[0], labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert module.classify(none, none, spark.createDataFrame([], LABELS)).count() == 0
    alone = module.classify(odd, none, spark.createDataFrame([], LABELS)).collect()
    assert {round(r.score, 6) for r in alone} == {empty}


def test_indicators_depend_on_the_text_alone():
    text = "Some (quoted) words!!! and *odd* ones, 12% " * 3 + "x" * 200 + "##########!?"
    fresh = sorted(quality.indicators(text, quality.Words()).tolist())
    words, rng = quality.Words(), random.Random(1)
    for _ in range(110):
        quality.indicators(" ".join("".join(rng.choice("#*!?-+=") for _ in range(9)) + "a" for _ in range(1000)), words)
    assert sorted(quality.indicators(text, words).tolist()) == fresh


@pytest.mark.parametrize("a, b", [("x" * 40 + "y", "x" * 40 + "z"), ("a" + "!?" * 30, "a" + "!?" * 30 + "."), ("-+" * 9 + "a", "-+" * 9 + "=a")])
def test_words_and_shapes_count_whole(a, b):
    one, two = (set(quality.indicators(x, quality.Words()).tolist()) for x in (a, b))
    assert one != two


def test_scores_match_a_plain_version(corpus):
    docs, labels = corpus
    rows = [(r.text, r.quality) for r in docs.join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()]
    model = quality.fit(rows)
    words = quality.Words()
    for text, _ in rows[:50]:
        z = model.bias + sum(float(model.weights[c]) for c in set(quality.indicators(text, quality.Words()).tolist()))
        assert model.score(quality.indicators(text, words)) == pytest.approx(1 / (1 + math.exp(-(model.slope * z + model.shift))), rel=1e-6)
    assert model.bias != 0
    assert model.score(quality.indicators("", words)) == pytest.approx(1 / (1 + math.exp(-(model.slope * model.bias + model.shift))))


def test_dual_descent_reaches_the_optimum():
    """Against subgradient descent on the primal."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + rng.normal(0, 0.5, 60) > 0, 1, -1)
    c = np.full(60, 0.3)
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.dual_descent([(np.arange(4), v) for v in x], y, 4, c, epochs=300)
    best = np.zeros(4)
    v = best.copy()
    for k in range(20_000):
        live = y * (x @ v) < 1
        v = v - 1 / (k + 10) * (v - ((c * y)[live, None] * x[live]).sum(0))
        best = v if loss(v) < loss(best) else best
    assert loss(w) <= loss(best) * 1.01


def test_a_repeated_id_gives_one_training_row(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0)], LABELS)
    got = training_rows(docs, labels, "quality", 10)
    assert got == [(t, y) for i, t, y in ((1, "a", 1), (2, "c", 0)) if zlib.crc32(str(i).encode()) % 5]


def test_filter_keeps_columns(spark, odd, none):
    model = quality.fit([])
    assert quality.keep_predicted(odd, model).collect() == odd.collect()
    assert quality.keep_predicted(none, model).count() == 0
