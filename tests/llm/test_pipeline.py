import base64
import hashlib
import math

import numpy as np
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from conftest_llm import brute_components, plain_distances, plain_match, plain_simhash  # noqa: E402
from lectern.llm import byte_bpe, decontamination, quality_classifier, quality_rules  # noqa: E402
from lectern.llm.common import training_rows  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(spark, sf_dir):
    """The stages on the driver, document by document, by plain versions; only the classifier's weights are the library's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", quality_classifier.TRAIN_ROWS)
    model = quality_classifier.fit(rows)

    def score(text):
        columns = set(quality_classifier.indicators(text, quality_classifier.Words()).tolist())
        return 1 / (1 + math.exp(-model.slope * (model.bias + sum(float(model.weights[c]) for c in columns)) - model.shift))

    left = [r for r in docs.collect() if score(r.text) >= quality_classifier.CUT]
    far = plain_distances(left)
    left = [r for r in left if far.get(r.doc_id, math.inf) <= quality_rules.CUTOFF]
    name = brute_components({r.doc_id: plain_simhash(r.text) for r in left})
    left = [r for r in left if name[r.doc_id] == r.doc_id]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = [c for t in items for w in t.split() if (c := w.strip(decontamination.MARKS))]
    small = {c.casefold() for c in words if not c[0].isdigit() and not c[0].isupper()}
    return {r.doc_id: r.text for r in left if not any(plain_match(r.text, i, small) for i in items)}


def test_run_matches_brute_force(spark):
    want = brute(spark, SMALL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(want) and 50 < len(want) < 200
    with open(byte_bpe.public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=byte_bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, text in want.items():
        ids = plain.encode_ordinary(text)
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, odd, none, number):
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, odd, SMALL)
    if number < 4:
        assert got.columns == odd.columns
    # ids that are left: 4 is clean; 5 is short, 7 repeats itself; texts without words are no good, and all alike
    left = [{None, 1, 2, 3, 4, 5, 6, 7}, {None, 4}, {None, 1, 4, 5, 6, 7}, {None, 1, 2, 3, 4, 5, 6, 7}, {None, 1, 2, 3, 4, 5, 6, 7}][number]
    assert {r.doc_id for r in got.collect()} == left if number else {r.doc_id for r in got.collect()} <= left
    assert stage(spark, none, SMALL).count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SMALL).columns == COLUMNS
