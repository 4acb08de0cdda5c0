from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from holdfast.llm import near_copies, simhash
from tests.llm import edges
from tests.llm.test_simhash import brute_fingerprint, clustered


def brute_set(text: str) -> set:
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def brute_kept(texts: dict, budget: int) -> set:
    """Smallest id of each component, by comparing everything with everything."""
    ids = sorted(texts)
    label = {i: i for i in ids}
    root = lambda i: i if label[i] == i else root(label[i])
    sets, fps = {i: brute_set(texts[i]) for i in ids}, {i: brute_fingerprint(texts[i]) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= budget and similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {root(i) for i in ids}


def corpus(seed: int = 5) -> dict:
    """Pairs of one to four changed words in 120, and a crowd of 80 copies of one text of which each has some words changed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = []

    def changed(words: list, n: int) -> str:
        words = list(words)
        for k in rnd.sample(range(len(words)), n):
            words[k] = word()
        return " ".join(words)

    for _ in range(40):
        base = [word() for _ in range(120)]
        texts += [" ".join(base), changed(base, rnd.randint(1, 4))]
    crowd = [word() for _ in range(150)]
    texts += [changed(crowd, rnd.randint(0, 3)) for _ in range(80)]
    rnd.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [512, 16])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for node_rows in (near_copies.NODE_ROWS, 16):
        kept = {r["doc_id"] for r in near_copies.representatives(docs, node_rows=node_rows).collect()}
        assert kept == brute_kept(texts, near_copies.BUDGET)
    assert len(kept) < 100


def test_stage_removes_near_copies_beyond_two_bits(spark):
    texts = corpus()
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    sets = {i: brute_set(t) for i, t in texts.items()}
    a, b = next((a, b) for a in texts for b in texts if a < b and similarity(sets[a], sets[b]) >= 0.8 and 2 < (fps[a] ^ fps[b]).bit_count() <= 11)
    docs = spark.createDataFrame([(a, texts[a]), (b, texts[b])], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [a]


def test_candidates_are_complete():
    fps = np.sort(np.array(clustered(800, 7), np.uint64))
    whole = {(a, b) for k, a in enumerate(fps.tolist()) for b in fps.tolist()[k + 1:] if (a ^ b).bit_count() <= 11}
    found = set()
    for by in range(0, 64, 16):
        turned = np.sort(np.bitwise_or(fps << np.uint64(by), fps >> np.uint64(64 - by)) if by else fps)
        # within one tree, and between its two halves one bit below the root
        cut = int(np.searchsorted(turned, np.uint64(1 << 63)))
        halves = [(turned, None, 0, 0)], [(turned[:cut], None, 1, 0), (turned[cut:], None, 1, 0), (turned[:cut], turned[cut:], 1, 1)]
        results = []
        for parts in halves:
            pairs = []
            for left, right, depth, errors in parts:
                for i, j in near_copies.near(left, right, depth, errors, 11, (16, 2)):
                    pairs += zip(left[i].tolist(), (left if right is None else right)[j].tolist())
            assert len(pairs) == len(set(pairs))
            results.append({tuple(sorted((z >> by | z << 64 - by) & (1 << 64) - 1 for z in p)) for p in pairs})
        head = {p for p in whole if ((p[0] ^ p[1]) << by >> 48 & 0xFFFF | (p[0] ^ p[1]) >> 64 - by + 48 if by else (p[0] ^ p[1]) >> 48).bit_count() <= 2} if not by else None
        assert results[0] <= whole and results[1] <= whole and (head is None or head <= results[0] & results[1])
        found |= results[0] & results[1]
    assert whole == found


def test_a_crowd_leaves_links_instead_of_pairs():
    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base ^ (1 << k) ^ (1 << m) for k in range(40) for m in range(k)], np.uint64))
    u, v, dense = near_copies.candidates_of(fps, None, 0, 0, 11, (16, 2))
    assert dense.all() and len(u) < len(fps)
    # every near pair is there or its ends hang together
    label = {x: x for x in fps.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(u[dense].tolist(), v[dense].tolist()):
        label[root(a)] = root(b)
    pairs = {frozenset(p) for p in zip(u[~dense].tolist(), v[~dense].tolist())}
    x = fps.tolist()
    assert all(frozenset((a, b)) in pairs or root(a) == root(b)
               for k, a in enumerate(x) for b in x[k + 1:] if ((a ^ b) >> 48).bit_count() <= 2)


def test_unlike_texts_with_near_fingerprints_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g a b c d e f g h i j k")], "doc_id long, text string")
    marks = near_copies.fingerprints(docs, "doc_id", "text").selectExpr("doc_id", "digest", "words", "0L AS fp")
    assert near_copies.links_of(docs, marks, "text", near_copies.BUDGET, 8).collect() == []


def test_edges(spark):
    docs = edges.documents(spark)
    kept = near_copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 2, 4, 7, 8]
    assert near_copies.representatives(docs.filter("doc_id = 5")).count() == 1
    assert near_copies.representatives(edges.empty(spark)).collect() == []
    assert simhash.BITS // near_copies.HEAD_BITS * (near_copies.HEAD_ERRORS + 1) > near_copies.BUDGET
