import random

import numpy as np
import pytest

from conftest_llm import plain_distances
from conftest_llm import plain_statistics as plain

from lectern.llm import quality_rules as q


def test_statistics_match_a_plain_count():
    rng = random.Random(5)
    texts = [None, "", "a b", "x y z x y z", "l\nl\n\n\nl \n", "# * $ <a> b"] + ["".join(rng.choice("ab \n#|") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    for t in texts:
        assert q.measure(t) == plain(t)


def test_mcd_ignores_outliers():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (600, q.P)), rng.normal(30, 1, (150, q.P))]
    mean, cov = q.mcd(np.ones(len(x)), x, np.einsum("ij,ik->ijk", x, x))
    assert np.abs(mean).max() < 0.3 and np.linalg.det(cov) < 8
    naive = np.cov(x.T)
    assert np.linalg.det(naive) > 100 * np.linalg.det(cov)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        w = ["".join(rng.choice("etaoin") for _ in range(rng.randint(3, 8))) for _ in range(120)]
        if k % 40 == 0:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w), "en", "hot" if k % 3 else "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_outliers_go_and_clean_documents_stay(corpus):
    got = q.quality_rules(corpus).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 400, 40))
    assert q.keep_good(corpus).count() == 390


def test_verdicts_match_estimates_from_rows(spark, corpus):
    """Independent of the grid's cells: all statistics by a plain count, estimates row by row."""
    want = plain_distances(corpus.collect())
    got = {r.doc_id: r for r in q.quality_rules(corpus).collect()}
    assert all(got[k].kept == (d <= q.CUTOFF) for k, d in want.items())
    near = [(got[k].distance, d) for k, d in want.items() if d > 1]
    assert all(abs(a - b) < 0.25 * b for a, b in near) and near


def test_each_statistic_can_decide_alone():
    """The most that it can be, against a group that doesn't vary."""
    most = (q.TOP[0], q.TOP[1], q.TOP[2], 0.5)  # more than half repeated words fail the base rule
    assert all((m / f) ** 2 > q.CUTOFF for m, f in zip(most, q.FLOOR))
    assert abs(1 - q.chi2_cdf(q.CUTOFF, q.P) - q.TAIL) < 1e-9


def test_small_groups_are_judged_much_as_the_language_or_the_corpus(spark):
    """60 sources of 2 documents, a language of 5, and a corpus of 12: all groups are small."""
    rng = random.Random(8)

    def text(bad):
        w = ["".join(rng.choice("etaoin") for _ in range(rng.randint(3, 8))) for _ in range(120)]
        return " ".join(x + "###" if bad else x for x in w)

    rows = [(k, text(k % 20 == 0), "en", f"s{k // 2}", 0) for k in range(120)] + [(200 + k, text(k == 0), None, None, 0) for k in range(5)]
    for some in (rows, rows[:12]):
        got = q.quality_rules(spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")).collect()
        assert all(r.distance is not None for r in got) and len(got) == len(some)
        assert {r.doc_id for r in got if not r.kept} == {r[0] for r in some if "#" in r[1]}


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_words): r for r in q.quality_rules(odd).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept
    assert got[4, 30_000].kept and got[4, 30_000].distance < 1  # the only one that passes
    assert got[7, 600].n_repeat_words == 600 and got[7, 600].base_failed
    kept = q.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4}
    assert q.quality_rules(none).count() == 0 and q.keep_good(none).count() == 0
