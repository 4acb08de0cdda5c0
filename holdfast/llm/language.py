"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point; whatever is not a letter is one
boundary symbol. A trigram binds its letters, each permuted by its position, by multiplication; a text bundles its trigrams
by addition; a language's prototype is the bundle of all its training texts. A text gets the language whose prototype,
centred on the mean of all prototypes, has the largest cosine with it.

Counting first and multiplying once (trigram counts of a block of texts times the block's trigram vectors) gives exactly
these sums. Training reads every document with a known language outside the held-out fifth; tasks return one partial sum per
language. A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned.
Texts of any length are used whole. Ties go to the first language in alphabetical order. A language
column of more than ``MOST_LANGUAGES`` values is refused. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import blocks, held_out, prepare, quoted

DIM = 1024
SEED = 11
#: trigrams whose vectors are held at once, and texts counted at once
GRAM_STEP, TEXT_STEP = 4096, 128
#: cells of a table of texts and trigrams that is counted at once
DENSE_CELLS = 1 << 25
#: a column with more values than this holds something else than languages
MOST_LANGUAGES = 4096


@functools.lru_cache(maxsize=4096)
def letter(code: int) -> np.ndarray:
    """The random vector of a code point (0: boundary)."""
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIM)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of texts: the distinct trigrams as rows of three code points, and for every occurrence the number of its
    text and of its trigram."""
    lowered = [x.lower() for x in texts]
    # every text has a boundary behind it, and the first one another in front
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le"), np.uint32)
    doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), [len(x) + 1 for x in lowered])])
    seen = np.unique(codes)
    letters = np.array([c for c in seen.tolist() if chr(c).isalpha()], np.uint32)
    number = np.zeros(len(seen), np.int64)
    number[np.isin(seen, letters)] = np.arange(1, len(letters) + 1)
    symbol = number[np.searchsorted(seen, codes)]
    kept = np.ones(len(symbol), bool)
    kept[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    symbol, doc = symbol[kept], doc[kept]
    # a trigram belongs to the text of its middle letter; around a boundary both letters must be of one text
    n = len(letters) + 1
    key = (symbol[:-2] * n + symbol[1:-1]) * n + symbol[2:]
    inside = symbol[1:-1] != 0
    spans = (symbol[1:-1] == 0) & (doc[:-2] == doc[2:])
    key, owner = key[inside | spans], doc[1:-1][inside | spans]
    if n ** 3 <= 1 << 22:
        present = np.zeros(n ** 3, bool)
        present[key] = True
        grams = np.flatnonzero(present)
        index = np.zeros(n ** 3, np.int32)
        index[grams] = np.arange(len(grams))
        index = index[key]
    else:
        grams, index = np.unique(key, return_inverse=True)
    code = np.concatenate([[0], letters]).astype(np.int64)
    return code[np.stack([grams // (n * n), grams // n % n, grams % n], 1)], owner, index


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: the first letter permuted twice, the second once."""
    codes, at = np.unique(grams, return_inverse=True)
    base = np.stack([letter(int(c)) for c in codes]) if len(codes) else np.zeros((0, DIM), np.int8)
    a, b, c = at.reshape(grams.shape).T
    return (np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]).astype(np.float32)


def bundle(rows: int, grams: np.ndarray, owner: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the trigram vectors of each of ``rows`` owners."""
    out = np.zeros((rows, DIM), np.float32)
    if not len(grams):
        return out
    if rows * len(grams) <= DENSE_CELLS:
        count = np.bincount(owner * len(grams) + index, minlength=rows * len(grams)).reshape(rows, len(grams)).astype(np.float32)
        for k in range(0, len(grams), GRAM_STEP):
            out += count[:, k:k + GRAM_STEP] @ gram_vectors(grams[k:k + GRAM_STEP])
        return out
    # many trigrams: their occurrences in order, a step of trigrams at a time and as many texts as fit beside it
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    some = max(1, DENSE_CELLS // GRAM_STEP)
    for k in range(0, len(grams), GRAM_STEP):
        a, b = np.searchsorted(index, [k, k + GRAM_STEP])
        vectors, width = gram_vectors(grams[k:k + GRAM_STEP]), min(GRAM_STEP, len(grams) - k)
        for low in range(0, rows, some):
            here = (owner[a:b] >= low) & (owner[a:b] < low + some)
            cells = (owner[a:b][here] - low) * width + index[a:b][here] - k
            high = min(rows, low + some)
            out[low:high] += np.bincount(cells, minlength=(high - low) * width).reshape(high - low, width).astype(np.float32) @ vectors
    return out


@dataclass
class Profiles:
    languages: list[str]
    centred: np.ndarray

    def compare(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest language and its cosine for every text vector."""
        norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        cosine = (vectors / norm) @ self.centred.T
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from all documents outside the held-out fifth whose language is known."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in blocks(batch):
                names = part.column("lang").to_pylist()
                order = sorted(set(names))
                owner_of = np.array([order.index(x) for x in names])
                grams, owner, index = trigrams(texts)
                for name, vector in zip(order, bundle(len(order), grams, owner_of[owner], index)):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(vector)], ["lang", "dim", "value"])

    prepare(docs.sparkSession)
    known = docs.filter(~held_out(quoted(doc_id)) & quoted(lang).isNotNull() & quoted(text).isNotNull())
    parts = known.select(quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang")).mapInArrow(
        partial, "lang string, dim int, value double")
    if known.select(quoted(lang)).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"column {lang} has more than {MOST_LANGUAGES} values")
    # one row per language: DIM numbers each, at most MOST_LANGUAGES rows
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).orderBy("lang").collect()
    languages = [r["lang"] for r in rows]
    if not rows:
        return Profiles([], np.zeros((0, DIM), np.float32))
    sums = np.array([[x["value"] for x in r["v"]] for r in rows])
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    centred = unit - unit.mean(axis=0) if len(unit) > 1 else unit
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, centred.astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) for every row."""
    prepare(docs.sparkSession)
    # one vector per language
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in blocks(batch):
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                for start in range(0, len(texts) if model.languages else 0, TEXT_STEP):
                    some = texts[start:start + TEXT_STEP]
                    vectors = bundle(len(some), *trigrams(some))
                    best, cosine = model.compare(vectors)
                    for k in np.flatnonzero([any(map(str.isalpha, x)) for x in some]):
                        names[start + k] = model.languages[best[k]]
                        scores[start + k] = min(1.0, max(0.0, float(cosine[k])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return source.mapInArrow(score, "doc_id long, lang_pred string, score double")
