from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from holdfast.llm import queries, spelling
from tests.llm import edges


def brute_words(docs) -> dict:
    """Word counts by the definition, one run at a time."""
    n = Counter()
    for ident, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(docs) -> set:
    n = brute_words(docs)
    # words one edit apart agree when one place is left out
    cells = defaultdict(set)
    for w in n:
        cells[w].add(w)
        for k in range(len(w)):
            cells[w[:k] + w[k + 1:]].add(w)
            cells[(k, w[:k] + w[k + 1:])].add(w)
    near = defaultdict(set)
    for cell in cells.values():
        for a in cell:
            near[a] |= {b for b in cell if b != a and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def found(frame) -> list:
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()]


def corpus(seed: int = 3) -> list:
    """Words with mistakes of three degrees of frequency, so that forms chain, and letters outside ASCII."""
    rnd = random.Random(seed)
    letters = "abcdeéßÀ×ÿ"
    words = []
    for _ in range(60):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11)))
        words += [word] * 300
        for n in (20, 2):
            k = rnd.randrange(len(word))
            word = rnd.choice([word[:k] + word[k + 1:], word[:k] + rnd.choice(letters) + word[k:], word[:k] + rnd.choice(letters) + word[k + 1:]])
            words += [word] * n
    rnd.shuffle(words)
    return [(i, rnd.choice([" ", ", ", "1"]).join(words[k:k + 25])) for i, k in enumerate(range(0, len(words), 25))]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 1])
def test_equals_brute_force(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(spelling, "PIECE_BLOCKS", 2)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = found(spelling.variants(frame, filter_bytes=filter_bytes))
    expected = brute(docs)
    assert set(rows) == expected and len(rows) == len(expected)
    assert any(form and root not in (word, form) for word, form, root, *_ in rows)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = found(queries.op12_spelling(spark, sf_dir))
    assert set(rows) == brute(docs) and len(rows) == len(set(rows)) > 100


def test_hash_of_an_edit_is_the_hash_of_the_edited_word():
    words = ["abcdefgh", "aabbccdd", "zzzzzzzzz", "ÀÿÀÿÀÿÀ"]
    every = spelling.Filters({s: (1, 0, np.full(spelling.BLOCK_WORDS, ~np.uint64(0))) for s in range(6, 11)})
    alphabet = np.array(sorted(map(ord, "abzÿ")), np.uint64)
    got = sorted((int(k), x) for k, x in spelling.probe(words, every, alphabet))
    expected = set()
    for k, w in enumerate(words):
        for i in range(len(w)):
            if len(w) > 7:
                expected.add((k, w[:i] + w[i + 1:]))
            expected |= {(k, w[:i] + c + w[i + 1:]) for c in "abzÿ" if c > w[i]}
    assert got == sorted(expected)
    for k, x in got:
        (at, codes), = spelling.by_length([x])
        h = (codes * spelling.powers(len(x))).sum(axis=1, dtype=np.uint64)
        only = np.zeros(spelling.BLOCK_WORDS, np.uint64)
        for j in range(spelling.PROBES):
            bit = int(spelling.bits_of(spelling.mixed(h), j)[0])
            only[bit >> 6] |= np.uint64(1 << (bit & 63))
        one = spelling.Filters({len(x): (1, 0, only)})
        assert (k, x) in {(int(a), b) for a, b in spelling.probe(words, one, alphabet)}


def test_long_text_is_cut_between_runs(monkeypatch):
    text = " ".join("word" * (1 + k % 5) for k in range(500))
    whole = spelling.RUN.findall(text)
    monkeypatch.setattr(spelling, "STEP_CHARS", 10)
    assert list(spelling.runs(text)) == whole


def test_edges(spark):
    docs = edges.documents(spark, [*edges.ROWS, (7, "Variant variant VARIANT varient ", "fr", "c", "x"), (8, "varient", "fr", "c", "x")])
    rows = found(spelling.variants(docs))
    assert set(rows) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert spelling.variants(edges.empty(spark)).collect() == []
    assert spelling.variants(docs.filter("text IS NULL")).collect() == []
