"""The registered queries against DuckDB, and the pipeline against its stages done by hand."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from holdfast.llm import oracles, queries, toxicity
from holdfast.llm.common import written
from tests.llm import edges
from tests.llm.test_decontaminate import brute as contaminated


@pytest.mark.parametrize("key", list(oracles.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, key):
    status, _, _ = compare.compare(spark, compare.duck(sf_dir), sf_dir, key)
    assert status == "ok"


def test_registered(spark):
    known = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(known)
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_sharding_query(spark, sf_dir):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r["shard"] for r in rows} == set(range(16))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)


def test_every_document_is_scored(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for key in ("op6_toxicity", "op8_lm_score", "op9_language"):
        rows = queries.QUERIES[key](spark, sf_dir).collect()
        assert len(rows) == n and len({r["doc_id"] for r in rows}) == n


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_of_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]


def test_toxicity_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    mild = stage("toxicity")(spark, docs, sf_dir)
    assert mild.columns == docs.columns
    assert {r["doc_id"] for r in mild.collect()} == {r["doc_id"] for r in scores if r["score"] < 0.5}
    assert any(r["score"] >= 0.5 for r in scores)


def test_near_dedup_stage(spark, sf_dir):
    """Exact similarity of five-word shingles over all pairs, without any budget of bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = {r["doc_id"] for r in stage("simhash_near_dedup")(spark, docs, sf_dir).collect()}
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in x)) if w] for i, x in text.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    label = {i: i for i in text}

    def root(i):
        return i if label[i] == i else root(label[i])

    ids = sorted(text)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    assert kept == {root(i) for i in ids} and len(kept) < len(ids)


def test_decontamination_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = {r["doc_id"] for r in docs.collect() if not any(contaminated(r["text"], x) for x in items)}
    pure = stage("benchmark_decontamination")(spark, docs, sf_dir)
    assert {r["doc_id"] for r in pure.collect()} == expected and pure.columns == docs.columns and len(expected) < docs.count()


def test_mixing_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = stage("mixing")(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    rows, size = docs.collect(), Counter()
    for r in rows:
        size[r["source"]] += len(r["text"])
    weight = sum(math.sqrt(s) for s in size.values())
    rate = {s: math.sqrt(n) / weight * sum(size.values()) / n for s, n in size.items()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in rows}
    assert sum(copies.values()) == pytest.approx(sum(rate[r["source"]] for r in rows), rel=0.35)


def test_sharding_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage("sharding")(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        docs = written(apply(spark, docs, sf_dir), name)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == docs.columns
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in docs.collect())


def put(folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, dotted and clashing names, empty and long texts, repeated rows; labels too few to learn from; empty tables."""
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    folder = put(tmp_path / "some", docs, labels, items)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        frame = written(apply(spark, frame, folder), name)
        assert frame.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r["doc_id"] for r in rows} <= {1, 2, 4, 7, 8}
    # a column named like the copy number keeps its values
    assert {r["copy"] for r in rows} <= {r["copy"] for r in docs.select("copy").collect()}
    nothing = put(tmp_path / "none", edges.empty(spark), labels.limit(0), items.limit(0))
    assert corpus_pipeline.run(spark, nothing).collect() == []
