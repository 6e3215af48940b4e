import numpy as np
import pytest

from karyospark.llm import quality as Q


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op9_weak_label_quality(spark, d).collect()}
    return rows, {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def test_held_out_accuracy(judged):
    """The labels table takes no part in the fit."""
    rows, quality = judged
    clean = [rows[k].kept for k, q in quality.items() if q == 1]
    junk = [rows[k].kept for k, q in quality.items() if q == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, k = 20000, len(Q.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.97, k)
    votes = np.where(rng.random((n, k)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random((n, k)) < 0.2] = 0
    patterns, counts = np.unique(((votes + 1) * 3 ** np.arange(k)).sum(1), return_counts=True)
    good, tables, prior = Q.label_model(patterns, counts)
    assert abs(prior - 0.8) < 0.02
    assert np.abs(tables[1][:, 2] - 0.8 * right).max() < 0.02
    assert np.abs(tables[0][:, 0] - 0.8 * right).max() < 0.04


def test_scorer_is_the_plain_sum(spark, judged):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = Q.fit(docs, sample_rows=50)
    got = {r.doc_id: r.score for r in Q.classify(docs, model).collect()}
    features = Q.Features(len(model.weights))
    for r in docs.limit(20).collect():
        words = Q.words_of(r.text)
        z = sum(float(model.weights[p]) for w in words for p in features.places(w)) / len(words)
        z += sum(v * float(model.weights[p]) for p, v in Q._document_features(Q.Tally(r.text, words), features))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(model.bias + Q.SCALE * z))), rel=1e-6)


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, " \n"), (None, "one two"), (3, "a " * 100_000), (4, "né ☃ 🙂"), (4, "né ☃ 🙂")]
    docs = spark.createDataFrame([(a, b, 9, "k") for a, b in rows], "doc_id bigint, text string, score int, kept string")
    out = Q.classify(docs, Q.fit(docs)).collect()
    assert len(out) == len(rows) and [r.kept for r in out if not (r.text or "").strip()] == [False] * 3
    empty = docs.limit(0)
    assert Q.classify(empty, Q.fit(empty)).count() == 0
