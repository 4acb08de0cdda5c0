from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import queries, suffixes
from tests.llm import edges


def brute(docs, length: int) -> list:
    """All strings of the given length counted, covered bytes removed."""
    times = Counter()
    for _, x in docs:
        b = (x or "").encode()
        times.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for i, x in docs:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame) -> list:
    return sorted(((r["doc_id"], r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in frame.collect()), key=str)


def corpus(length: int, seed: int) -> list:
    """Passages a little shorter, equal and longer than the length, at starts, ends and inside, overlapping parts of one
    passage, repeats inside one document, short periods, copies, and characters of several bytes."""
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = noise(6 * length)
    docs = []
    for _ in range(60):
        parts = [noise(rnd.choice([0, 1, 30, 2 * length]))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randrange(4 * length)
            parts += [passage[a:a + rnd.choice([length - 3, length - 1, length, length + 1, length + 9, 2 * length])], noise(rnd.choice([0, 1, 5, length]))]
        docs.append("".join(parts))
    docs += [passage, "x" * (3 * length), "ab" * length, ("cycle of words " * length)[:3 * length], docs[0] + "!" + docs[1], docs[2], docs[2]]
    own = noise(2 * length)
    docs += [own + noise(9) + own, "y" * length, "y" * (length - 1), "z" * length, "z" * length, "", None]
    return list(enumerate(docs))


@pytest.mark.parametrize("length, step, bucket", [(400, 1 << 20, 1 << 20), (48, 1 << 20, 64), (100, 37, 500), (64, 100, 7)])
def test_equals_brute_force(spark, monkeypatch, length, step, bucket):
    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "PART", 16)
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0 if bucket == 64 else 500_000)
    docs = corpus(length, length)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(suffixes.without_repeats(frame, length)) == brute(docs, length)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op13_suffix_dedup(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str) == brute(docs, 400)
    assert any(0 < r["n_removed"] < r["n_bytes"] for r in rows)


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 8)
    rng = np.random.default_rng(1)
    for spread in (2, 50, 1 << 40):
        tokens = [rng.integers(-spread, spread, 5000) for _ in range(3)]
        order = suffixes.multikey(tokens)
        assert sorted(order) == list(range(5000))
        rows = list(zip(*(t[order].tolist() for t in tokens)))
        assert rows == sorted(rows)


def test_spans_and_kept_bytes_make_up_the_text(spark):
    docs = corpus(400, 9)
    for r in suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = (dict(docs)[r["doc_id"]] or "").encode()
        ends = [0, *r["ends"]]
        assert b"".join(text[a:b] for a, b in zip(ends, [*r["starts"], len(text)])) == r["kept"]


def test_edges(spark):
    docs = edges.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, x if x is None or len(x) < 9000 else x[:1200]) for i, x in rows]  # of a period of five, all goes
    got = found(suffixes.without_repeats(docs))
    assert [r[0::2][:1] + r[3:] for r in got] == [r[0::2][:1] + r[3:] for r in brute(rows, 400)]
    assert max(r[2] for r in got) == len(edges.LONG)
    assert suffixes.without_repeats(edges.empty(spark)).collect() == []
    # rows equal in id and text are copies; a null id is not the id 0
    twice = [(None, "q" * 10 + "r" * 390), (None, "q" * 10 + "r" * 390), (0, "s" * 399 + "t"), (None, "s" * 399 + "u")]
    assert [r[2] for r in found(suffixes.without_repeats(spark.createDataFrame(twice, "doc_id long, text string")))] == [0, 0, 400, 400]
    with pytest.raises(ValueError):
        suffixes.window_of(47)
