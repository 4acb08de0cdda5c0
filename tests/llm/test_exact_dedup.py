from __future__ import annotations

from holdfast.llm import exact_dedup
from holdfast.llm.exact_dedup import DigestIndex
from tests.llm import edges


def test_rules_of_the_contract(spark):
    rows = [(4, "a b"), (2, "ab"), (9, "a  b"), (7, "a\t\tb"), (1, "x"), (8, "X"), (3, None), (6, " "), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in DigestIndex.temporary(spark).ingest(docs).collect()}
    assert {i: r["keep_id"] for i, r in out.items()} == {4: 7, 2: 7, 9: 7, 7: 7, 1: 1, 8: 8, 3: 6, 6: 6, 5: 6}
    assert {i for i, r in out.items() if r["kept"]} == {7, 1, 8, 6}
    assert out[4]["group_size"] == 4 and out[3]["group_size"] == 3


def test_later_batches_meet_the_filled_index(spark):
    index = DigestIndex.temporary(spark, buckets=4)
    batches = [[(1, "a"), (2, "b b")], [(10, "a "), (11, "c"), (12, "c"), (13, "bb")], [(0, "a"), (14, "b  b"), (15, "d")]]
    expected = [
        {1: (1, True, 1), 2: (2, True, 1)},
        {10: (10, True, 2), 11: (11, True, 2), 12: (11, False, 2), 13: (2, False, 2)},
        {0: (10, False, 3), 14: (14, True, 3), 15: (15, True, 1)}]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in batches]
    for frame, want, known in zip(frames, expected, (2, 3, 4)):
        out = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in index.ingest(frame).collect()}
        assert out == want and index.read().count() == known
    # a longer text that arrives later takes over the group
    whole = exact_dedup.digests(frames[0].union(frames[1]).union(frames[2]))
    out = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in index.resolve(whole).collect()}
    assert {i: out[i] for i in (1, 10, 0)} == {1: (10, False, 3), 10: (10, True, 3), 0: (10, False, 3)}
    assert {i: out[i] for i in (2, 13, 14)} == {2: (14, False, 3), 13: (14, False, 3), 14: (14, True, 3)}
    plan = index.keepers()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan  # both tables are bucketed by digest
    index.drop()


def test_any_number_of_batches_gives_the_same_rows(spark):
    docs = spark.createDataFrame([(i % 50, "ab c"[: 1 + i % 4] + " " * (i % 7)) for i in range(200)] + [(None, "a"), (None, "a")], "doc_id long, text string")
    tables = spark.sql("SHOW TABLES").count()
    rows = [sorted((str(r) for r in exact_dedup.deduplicated(docs, n).collect())) for n in (1, 2, 5)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 202
    assert spark.sql("SHOW TABLES").count() == tables


def test_hot_group_takes_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    docs = spark.range(40).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE string(id) END AS text")
    out = DigestIndex.temporary(spark, 4).ingest(docs).collect()
    assert len(out) == 40 and {r["keep_id"] for r in out if r["group_size"] == 20} == {0}
    assert sum(r["kept"] for r in out) == 21


def test_edges(spark):
    out = DigestIndex.temporary(spark, 4).ingest(edges.documents(spark)).collect()
    assert len(out) == len(edges.ROWS)
    alpha = [r for r in out if r["keep_id"] == 1]
    assert {r["group_size"] for r in alpha} == {4} and len(alpha) == 4 and sum(r["kept"] for r in alpha) == 1
    blank = [r for r in out if r["keep_id"] == 6]
    assert len(blank) == 4 and sum(r["kept"] for r in blank) == 1
    twice = spark.createDataFrame([(None, "q"), (None, "q"), (5, "q"), (5, "q"), (-3, "q")], "doc_id long, text string")
    rows = DigestIndex.temporary(spark, 4).ingest(twice).collect()
    assert {r["keep_id"] for r in rows} == {-3} and sum(r["kept"] for r in rows) == 1
    nulls = DigestIndex.temporary(spark, 4).ingest(twice.filter("doc_id IS NULL")).collect()
    assert [r["keep_id"] for r in nulls] == [None, None] and sum(r["kept"] for r in nulls) == 1
    extremes = spark.createDataFrame([(-(1 << 63), "e"), ((1 << 63) - 1, "e")], "doc_id long, text string")
    assert {r["keep_id"] for r in DigestIndex.temporary(spark, 4).ingest(extremes).collect()} == {-(1 << 63)}
    assert DigestIndex.temporary(spark, 4).ingest(edges.empty(spark)).collect() == []
