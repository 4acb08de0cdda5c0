from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pytest

from holdfast.llm import toxicity
from tests.llm import edges


def brute_marginals(emission, transition):
    """Sum over all state sequences of one text."""
    total, toxic = 0.0, np.zeros(len(emission))
    for states in itertools.product((0, 1), repeat=len(emission)):
        before, weight = 2, 0.0
        for e, s in zip(emission, states):
            weight += transition[before, s] + e * s
            before = s
        total += np.exp(weight)
        toxic += np.exp(weight) * np.array(states)
    return toxic / total


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 8, size=rng.integers(1, 9))
        emission, transition = rng.normal(0, 3, lengths.sum()), rng.normal(0, 1, (3, 2))
        first = np.zeros(lengths.sum(), bool)
        first[np.cumsum(lengths) - lengths] = True
        got = toxicity.marginals(emission, first, transition)
        parts = np.split(emission, np.cumsum(lengths)[:-1])
        assert got == pytest.approx(np.concatenate([brute_marginals(p, transition) for p in parts]), abs=1e-9)


def test_long_sequences_and_extreme_emissions_stay_finite():
    emission = np.where(np.arange(50_000) % 3, 20.0, -20.0)
    first = np.zeros(50_000, bool)
    first[0] = True
    p = toxicity.marginals(emission, first, np.array([[1.0, -1], [-1, 1], [0, 0]]))
    assert np.isfinite(p).all() and 0 <= p.min() and p.max() <= 1


def test_spans_are_code_points_and_join():
    text = "é \U0001f600 bad worse, fine bad"
    assert toxicity.spans(text, np.array([0.1, 0.9, 0.8, 0.2, 0.7])) == ([4, 20], [13, 23])


def planted(n=600):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdeilmnorstu"), 6)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, 60))
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words[rng.integers(60)] = rng.choice(["zounds", "Blasted", "knavish"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_documents_and_their_spans(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for i, text, y in rows:
        if zlib.crc32(str(i).encode()) % 5 == 0:
            assert (out[i]["score"] >= 0.5) == bool(y)
        found = {text[a:b].lower() for a, b in zip(out[i]["span_starts"], out[i]["span_ends"])}
        assert found <= {"zounds", "blasted", "knavish"} or any(" " in f for f in found)
        assert bool(found) == bool(y)
    kept = toxicity.reject(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in out if out[i]["score"] < 0.5}


def test_labels_of_held_out_documents_are_never_read(spark):
    rows = planted(200)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    frame = lambda f: spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")
    a = toxicity.train(docs, frame(lambda i, y: y))
    b = toxicity.train(docs, frame(lambda i, y: 1 - y if held(i) else y))
    assert a.weights == b.weights and (a.document == b.document).all()


def test_edges(spark):
    docs, labels = edges.documents(spark), spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0)), toxicity.train(edges.empty(spark), labels)):
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == len(edges.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 6, 7)} == {0}
        assert [r["n_tokens"] for r in rows if r["doc_id"] == 4] == [60_000]
        assert toxicity.score(edges.empty(spark), model).collect() == []
        assert set(toxicity.reject(docs, model).columns) == set(docs.columns)


def test_long_labelled_texts_are_learned_from(spark):
    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    docs, labels = [], []
    for i in range(120):
        text = list(rnd.choice(words, 1300))
        if i % 3 == 0:
            for k in rnd.integers(0, 1300, 30):
                text[k] = "scumbagged"
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    assert min(len(x) for _, x in docs) > toxicity.SAMPLE_CHARS
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights
    score = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels)


def test_sample_keeps_its_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20)
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (5 if i < 5 else 60 if i < 200 else 500)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, toxic int")
    rows, _ = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    size = [len(x) for x, _ in rows]
    assert len(rows) <= 10 and sum(size) <= 200 and min(size) < 20 < max(size) < 500


def test_untrained_model_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(5)], "doc_id long, text string")
    for rows in ([(1, 1)], [(1, 1), (2, 1)], []):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.reject(docs, model).count() == 5


def test_learning_is_not_done_on_the_driver(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    want, driver, fit = toxicity.fit(*toxicity.sample(docs, labels, "doc_id", "text", "toxic")), os.getpid(), toxicity.fit

    def elsewhere(rows, share):
        assert os.getpid() != driver
        return fit(rows, share)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.train(docs, labels)
    assert got.weights == want.weights and got.document.tolist() == want.document.tolist()
