from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import lexical
from tests.llm import edges


def brute_terms(text) -> Counter:
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found)


def brute(docs, items, k=20) -> list:
    bags = [(i, brute_terms(x)) for i, x in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for ident, b in bags:
            m = 100 - 25 + (25 * b.total() * n_docs) // n_terms
            score = 0
            for t, c in brute_terms(text).items():
                if b[t]:
                    score += c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                rows.append((-score, ident is None, ident))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank, ident, -score) for rank, (score, _, ident) in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def found(frame) -> list:
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def corpus(seed: int = 11):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Äther", "äther", "ÄTHER", "The", "the"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([3, 20, 60, 400])))) for i in range(400)]
    # copies, many repeats of one term, ties
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000, "w250 " * 500), (2001, "w250"), (2002, "w250")]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(30)] + [(30, docs[7][1]), (31, "w250 w250"), (32, "unseen"), (33, None)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"FLUSH": 500, "BLOCK_DOCS": 16, "LEAST_DOCS": 4, "ITEM_BLOCK": 7, "STEP_CHARS": 50}.items():
            monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (20, 3):
        assert found(lexical.ranked(frame, asked, k)) == brute(docs, items, k)


def test_bounds_are_never_too_low_and_exclude(spark):
    """Signature levels are at least the true ones, and most documents of a search are never scored."""
    docs, items = corpus()
    flush = lexical.Flush()
    for ident, x in docs:
        flush.add(ident, x)
    row = flush.batch().to_pylist()[0]
    bags = {i: brute_terms(x) for i, x in docs}
    n_docs, n_terms = len(docs), sum(b.total() for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    queries = lexical.Queries([str(i) for i, _ in items], [x or "" for _, x in items], df, n_docs)
    first = offset = 0
    for n, bits in zip(row["block_docs"], row["block_bits"]):
        width = -(-n // 8)
        signature = np.frombuffer(row["signatures"], np.uint8, bits * width, offset).reshape(bits, width)
        reached = lexical.levels_reached(queries, signature, n)
        for t, k in queries.number.items():
            true = np.searchsorted(lexical.LEVELS, [bags[i][t] for i in row["doc_ids"][first:first + n]], "right")
            assert (reached[k] >= true).all()
        first, offset = first + n, offset + bits * width
    best, scored = lexical.Best(len(items), 3), []
    add = best.add
    best.add = lambda q, scores, *rest: (scored.append(len(scores)), add(q, scores, *rest))
    lexical.search_row(row, queries, best, n_docs, n_terms)
    assert 0 < sum(scored) < 0.5 * len(docs) * len(items)


def test_edges(spark):
    docs = edges.documents(spark)
    items = docs.selectExpr("doc_id AS item_id", "*")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(lexical.ranked(docs, items)) == brute(rows, rows)
    assert lexical.ranked(edges.empty(spark), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs.filter("text IS NULL"), items).collect() == []
