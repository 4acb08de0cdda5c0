from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import queries, term_score
from tests.llm import edges


def test_terms():
    assert term_score.terms("The a_1, Ärger!") == ["the", "a_1", ",", "ärger", "!", ""]
    assert term_score.terms("中文字符 ab中文") == ["中文字", "文字符", "ab", "中文", ""]
    assert term_score.terms("हिन्दी है") == ["हिन्दी", "है", ""]
    assert term_score.terms("") == [""]


def test_scores_by_definition(spark):
    docs = [(1, "Banana is good"), (2, "is a banana, a"), (3, None), (4, ""), (5, "中文字符"), (6, "漢語大詞"), (2, "is a banana, a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")
    models = [Counter(t for i, x in docs if x is not None and i in ids for t in term_score.terms(x)) for ids in ({1, 2}, {1, 2, 4, 5, 6})]
    size = len(models[1])
    got = term_score.score(frame, targets).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2, 3, 4, 5, 6]
    for r in got:
        own = term_score.terms(dict(docs)[r["doc_id"]] or "")
        loss = [np.mean([-np.log((m[t] + 0.5) / (m.total() + 0.5 * size)) for t in own]) for m in models]
        assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == (len(own), pytest.approx(loss[0]), pytest.approx(loss[1]))
        assert r["score"] == pytest.approx(loss[0] - loss[1])


@pytest.mark.parametrize("block, per_range", [(4_000_000, 2_000_000), (20, 3)])
def test_pair_scores_by_definition(spark, monkeypatch, block, per_range):
    monkeypatch.setattr(term_score, "BLOCK_CHARS", block)
    monkeypatch.setattr(term_score, "RANGE_TERMS", per_range)
    docs = [(1, "Banana is good"), (2, "is a banana, a"), (3, None), (4, ""), (5, "中文字符"), (6, "good is banana"), (2, "is a banana, a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    targets = spark.createDataFrame([(1,), (2,), (None,), (99,)], "doc_id long")

    def model(ids):
        texts = [term_score.terms(x) for i, x in docs if x is not None and i in ids]
        return Counter(t for x in texts for t in x), Counter(p for x in texts for p in zip([x[-1], *x], x))

    models = [model({1, 2}), model({1, 2, 4, 5, 6})]
    vocabulary = len(models[1][0])
    got = term_score.score(frame, targets, order=2).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2, 3, 4, 5, 6]
    for r in got:
        own = term_score.terms(dict(docs)[r["doc_id"]] or "")
        loss = []
        for one, two in models:
            share = {t: (one[t] + 0.5) / (one.total() + 0.5 * vocabulary) for t in own}
            loss.append(np.mean([-np.log((two[v, w] + 5 * share[w]) / (one[v] + 5)) for v, w in zip([own[-1], *own], own)]))
        assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == (len(own), pytest.approx(loss[0]), pytest.approx(loss[1]))


def test_query_counts_the_order_of_words(spark, tmp_path):
    docs = [(1, "old dogs bite young cats"), (2, "old dogs bite young cats"), (3, "cats young bite dogs old")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {r["doc_id"]: r["target_loss"] for r in queries.op8_lm_score(spark, str(tmp_path)).collect()}
    assert score[2] < score[3] - 0.5


def test_query_tells_rare_characters_apart(spark, tmp_path):
    """Two documents in characters beyond the 126 most frequent, one of them like the target."""
    common = "".join(chr(0x3b1 + 1000 + k) * 9 for k in range(130))
    docs = [(1, "龍鳳麟龜" * 3), (2, "龍鳳麟龜" * 2), (3, "鷹虎豹狼" * 2), (4, common)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in queries.op8_lm_score(spark, str(tmp_path)).collect()}
    assert score[2] < score[3] - 0.5


def test_edges(spark):
    docs = edges.documents(spark)
    targets = docs.filter("doc_id = 1").select("doc_id")
    rows = term_score.score(docs, targets).collect()
    assert len(rows) == len(edges.ROWS) and all(np.isfinite(r["score"]) for r in rows)
    assert len(term_score.score(docs, targets.limit(0)).collect()) == len(edges.ROWS)
    assert len(term_score.score(docs.filter("text IS NULL"), targets).collect()) == 2
    assert term_score.score(edges.empty(spark), targets).collect() == []


def test_a_range_is_added_up_in_little_more_memory_than_it_takes():
    rng = np.random.default_rng(1)
    blocks = [np.unique(rng.integers(0, 1 << 20, 50_000, np.uint64)) for _ in range(20)]
    n = [rng.integers(0, 1000, len(x)) for x in blocks]
    table = pa.table({
        "block": [str(i) for i in range(20)], "part": pa.array([0] * 20, pa.int32()),
        "keys": pa.array([term_score.planes(np.diff(x, prepend=np.uint64(0))) for x in blocks], pa.binary()),
        "n": pa.array([term_score.planes(x) for x in n], pa.binary()), "n_target": pa.array([term_score.planes(x // 2) for x in n], pa.binary())})
    term_score.added(table.slice(0, 1))
    tracemalloc.start()
    got = term_score.added(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # both count columns come back; the sums themselves took 2.6 times the table before
    assert peak < 1.7 * table.nbytes
    for name, parts in (("n", n), ("n_target", [x // 2 for x in n])):
        total = np.bincount(np.concatenate(blocks).astype(np.int64), weights=np.concatenate(parts))
        for i, x in enumerate(got.column(name).to_pylist()):
            assert (term_score.unplaned(x, np.int64) == total[blocks[i].astype(np.int64)]).all()
    every = np.unique(np.concatenate(blocks))
    assert got.column("new_terms").to_pylist() == [int((every & np.uint64(1) == 0).sum())] + [0] * 19
