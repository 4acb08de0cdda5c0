from __future__ import annotations

import itertools
import random
import re

import numpy as np

from holdfast.llm import decontaminate as d
from tests.llm import edges


def brute(doc: str | None, item: str | None) -> bool:
    """Every window of the item against every place of the document."""
    dense = lambda c: "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0eff"
    spaced = ["".join(f" {c} " if dense(c) else c for c in (x or "").lower()) for x in (doc, item)]
    text, passage = [re.findall(r"[^\W_]+", x) for x in spaced]
    if len(passage) < 3:
        return bool(passage) and text == passage
    size = min(d.WINDOW, len(passage))
    need = d.WINDOW - d.MAX_SUBS if size == d.WINDOW else size
    return any(
        sum(a == b for a, b in zip(text[i:i + size], passage[j:j + size])) >= need
        for j in range(len(passage) - size + 1) for i in range(len(text) - size + 1))


def test_masks_are_complete():
    for gone in itertools.combinations(range(d.WINDOW), d.MAX_SUBS):
        assert any(
            not {p + k for p in mask} & set(gone) for mask in d.MASKS for k in range(d.WINDOW - mask[-1])), gone


def make(seed=4):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("the of and to in that for with on at by from".split() + [f"w{i}" for i in range(150)])
    items = [" ".join(word() for _ in range(rnd.choice([3, 5, 6, 8, 12, 13, 14, 40]))) for _ in range(25)]
    items += [None, "", "same same same same same same same", items[0]]
    docs = []
    for _ in range(250):
        words = [word() for _ in range(rnd.randint(0, 80))]
        passage = (rnd.choice(items) or "").split()
        if rnd.random() < 0.7 and passage:
            cut = rnd.randint(0, len(passage) // 2) if rnd.random() < 0.5 else 0
            passage = passage[cut:]
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 6])):
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = [p.upper() if rnd.random() < 0.3 else p for p in passage]
        docs.append(rnd.choice([" ", ", ", "\n"]).join(words))
    return docs + [None, "", "same " * 400], items


def test_pairs_equal_brute_force(spark):
    docs, items = make()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminations(frame, benchmark).collect()}
    expected = {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if brute(x, y)}
    assert got == expected and len(expected) > 30
    kept = d.clean(frame, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in expected}


def test_short_and_unspaced_items(spark):
    chinese = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少你好世界"
    items = ["answer is forty two exactly", chinese, "ja nein", "solo", "カタカナ文", "one two three four five six seven", "ภาษาไทยยากมาก"]
    docs = [
        "some say the ANSWER is forty-two, exactly that", "answer is forty two roughly", "前言" + chinese + "后记。", "前言" + chinese[:5] + "后记",
        chinese[:6] + "一" + chinese[7:], "ja, nein!", "sie sagt ja nein dazu", "solo", "solo solo", "これはカタカナ文です", "zero one two three four five six seven",
        "one two three four five six", "ใครว่าภาษาไทยยากมากนะ", "", None]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminations(frame, benchmark).collect()}
    assert got == {(0, 0), (2, 1), (4, 1), (5, 2), (7, 3), (9, 4), (10, 5), (12, 6)}
    assert got == {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if brute(x, y)}


def test_bitmap_grows_with_the_benchmark(spark):
    keys = [d.wanted_of(spark.range(n).selectExpr("xxhash64(id) AS key"), set()) for n in (10, 100_000)]
    assert [k.digits for k in keys] == [d.LEAST_BITS, 22] and [len(k.bitmap) for k in keys] == [1 << 17, 1 << 19]
    few = d.wanted_of(spark.range(10).selectExpr("xxhash64(id) AS key"), set())
    own = [r["k"] for r in spark.range(10).selectExpr("xxhash64(id) AS k").collect()]
    one, two = d.bit_numbers(np.array(own, np.int64).view(np.uint64), few.digits)
    assert d.is_set(few.bitmap, one).all() and d.is_set(few.bitmap, two).all()


def test_query_finds_the_planted_passages_only(spark, sf_dir):
    from holdfast.llm.queries import op2_decontamination

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontamination(spark, sf_dir).collect()}
    whole = {(i, j) for i, x in docs.items() for j, y in items.items() if y in x}
    assert whole <= got
    assert all(brute(docs[i], items[j]) for i, j in got)


def test_edges(spark):
    docs = edges.documents(spark)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    more = docs.unionByName(docs.filter("doc_id IS NULL AND text IS NOT NULL").selectExpr(
        "doc_id", f"'{item}' AS text", *[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]))
    benchmark = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "word word")], "item_id long, text string")
    rows = d.contaminations(more, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in rows) == [(None, 0), (None, 1)]
    kept = d.clean(more, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(edges.ROWS)
    assert d.contaminations(edges.empty(spark), benchmark).collect() == []
    assert d.contaminations(more, benchmark.limit(0)).collect() == [] and d.clean(more, benchmark.limit(0)).count() == len(edges.ROWS) + 1
