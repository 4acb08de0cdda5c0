from __future__ import annotations

from collections import Counter

import numpy as np

from holdfast.llm import sharding
from tests.llm import edges


def _check(rows, n, shards):
    assert len(rows) == n
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(k, 0) for k in range(shards)), default=0) <= 1
    for k, c in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(c))


def test_every_row_once_in_equal_shards(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) AS text")
    out = sharding.shard(docs, n_shards=16, bucket_bytes=4096)
    rows = out.collect()
    _check(rows, 1000, 16)
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))


def test_same_seed_same_order_other_seed_other_order(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "string(id) AS text")
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 4, seed, 4096).collect()}
    one, other = place(1), place(2)
    assert one == place(1)
    assert sum(one[i] == other[i] for i in one) < 30


def test_order_is_unrelated_to_ids(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    rows = sharding.shard(docs, 4, 3, 20_000).collect()
    ids = np.array([r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"] * 4 + r["shard"])])
    assert abs(np.corrcoef(ids, np.arange(4000))[0, 1]) < 0.08


def test_permute_is_a_permutation_that_depends_on_the_hashes_only():
    hashes = np.array([5, 3, 9, 1])
    a = hashes[sharding.permute(7, hashes, 1)]
    b = hashes[::-1][sharding.permute(7, hashes[::-1], 1)]
    assert sorted(a) == [1, 3, 5, 9] and list(a) == list(b)


def test_edges(spark):
    docs = edges.documents(spark)
    out = sharding.shard(docs, 3)
    _check(out.collect(), len(edges.ROWS), 3)
    assert set(out.columns) == set(docs.columns)  # shard and slot replace columns of these names
    assert sharding.shard(edges.empty(spark), 3).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.range(64).selectExpr("id AS doc_id", "string(id) AS text")
    sharding.write_shards(sharding.shard(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect().__len__() == 4
