from __future__ import annotations

import zlib

import numpy as np
import pytest

from holdfast.llm import language
from tests.llm import edges


def brute_vector(text: str) -> np.ndarray:
    """Bind and bundle letter by letter."""
    symbols = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or symbols[-1]:
            symbols.append(code)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(language.DIM)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        total += np.roll(language.letter(a).astype(int), 2) * np.roll(language.letter(b).astype(int), 1) * language.letter(c)
    return total


def test_bundles_by_definition():
    texts = ["Ab ba!", "", "é\nß", "12", "xx-yy zz", "İstanbul", "a"]
    got = language.bundle(len(texts), *language.trigrams(texts))
    for vector, text in zip(got, texts):
        assert vector == pytest.approx(brute_vector(text)), text


def test_many_letters_take_the_sorted_way():
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300))
    assert language.bundle(1, *language.trigrams([text]))[0] == pytest.approx(brute_vector(text))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.learn(docs)).collect()}
    held = [(r["doc_id"], r["lang"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([found[i] == y for i, y in held]) > 0.95


def test_edges(spark):
    docs = edges.documents(spark)
    profiles = language.learn(docs)
    rows = language.identify(docs, profiles).collect()
    assert len(rows) == len(edges.ROWS)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6, 7)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = language.learn(edges.empty(spark))
    assert nothing.languages == [] and {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(edges.empty(spark), profiles).collect() == []


def test_many_trigrams_are_counted_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x5200, 300))) for _ in range(40)]
    whole = language.bundle(len(texts), *language.trigrams(texts))
    monkeypatch.setattr(language, "DENSE_CELLS", 7 * language.GRAM_STEP)
    assert np.array_equal(language.bundle(len(texts), *language.trigrams(texts)), whole)


def test_a_column_that_holds_no_languages_is_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "text", f"v{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.learn(docs)
