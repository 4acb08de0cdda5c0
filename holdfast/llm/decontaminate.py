"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased and hashed; in scripts without blanks (Han, Kana, Thai, Lao, Khmer, Burmese)
every character is a token. A mask picks some positions of a stretch of tokens and ignores
the others; the hash of the picked ones is a seed. Seeds of the benchmark items and of the documents are joined, and around
every hit the two texts are compared position by position: a document is contaminated by an item if some ``WINDOW``
consecutive tokens of the item stand in it with at most ``MAX_SUBS`` of them replaced. The masks are complete for that: every
window with so few replacements, wherever they are, keeps the picked positions of one of the masks somewhere.

An item of three to twelve tokens must occur whole and unchanged; below six tokens its seed is the hash of the whole sequence.
An item of one or two tokens is found only in a document that has no other tokens. Texts without tokens, null and empty ones
are looked for nowhere and contain nothing. Repeated rows and items count like any other; hits of rows with the same doc_id are reported together.
Documents of any length are read whole. Extra columns are ignored by ``contaminations`` and kept by ``clean``.

Scale: the documents' seeds are first tested in their own task against a bitmap of the benchmark's seeds, of about
``BITS_PER_SEED`` bits a seed and 32 MB at most; what passes (all true hits, and the more others the larger the benchmark) is joined by Spark with the benchmark's
seeds, together with the tokens around it, so that no text is read or moved twice. A passage that a third of all documents
share gives one key many rows, which adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import blocks, packed, prepare, quoted, unpacked, written

#: scripts without blanks between words
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(r"[^\W_]+")
MIXED_TOKEN = re.compile(rf"[^\W_{DENSE}]+|(?![\W_])[{DENSE}]")
DENSE_RUN = re.compile(f"[{DENSE}]")
WINDOW, MAX_SUBS = 13, 3
#: complete for thirteen tokens with three replacements: tests try all 286 placements
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 6, 8, 9))
#: whole sequences of short items, and the tokens from which one is looked for inside longer documents
SHORT = tuple(tuple(range(n)) for n in range(1, 6))
LEAST = 3
#: tokens kept on each side of a hit
REACH = WINDOW - 1
#: bits of the bitmap of benchmark seeds per seed, and the least and most binary digits of a bit's number
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 32, 20, 28
#: distinct tokens whose hashes a task remembers
REMEMBER = 300_000
#: digests of contaminated texts are broadcast up to this many (about 50 bytes each)
BROADCAST_TEXTS = 500_000
SEEDS = "key long, at int, around array<long>"


class TokenHashes(dict):
    """64-bit hash of each token seen (never 0, which means no token); forgotten when they become too many."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token) or 1
        return value


def token_hashes(texts: list[str], known: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, and how many each text has."""
    parts = []
    for x in texts:
        x = x.lower()
        token = TOKEN if x.isascii() or not DENSE_RUN.search(x) else MIXED_TOKEN
        tokens = token.findall(x) if len(x) < 1 << 20 else (m.group() for m in token.finditer(x))
        parts.append(np.fromiter(map(known.__getitem__, tokens), np.uint64))
    return np.concatenate(parts), np.array([len(p) for p in parts])


def seeds(hashes: np.ndarray, owner: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a mask (of MASKS, then of SHORT) fits into one text, and the seed there."""
    picked = (*MASKS, *SHORT)[mask]
    n = len(hashes) - picked[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    key = np.full(n, mask + 1, np.uint64)
    for p in picked:
        key = (key ^ hashes[p:p + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    fits = owner[:n] == owner[picked[-1]:]
    return np.flatnonzero(fits), key[fits]


def bit_numbers(keys: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in a bitmap whose bits have numbers of so many binary digits."""
    shift = np.uint64(64 - digits)
    return keys >> shift, (keys * np.uint64(0xD6E8FEB86659FD93)) >> shift


def is_set(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def around(hashes: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens REACH to the left and right of positions; 0 where the text has none."""
    padded = np.concatenate([np.zeros(REACH, np.uint64), hashes, np.zeros(REACH, np.uint64)])
    place = np.concatenate([np.full(REACH, -1), owner, np.full(REACH, -1)])
    index = at[:, None] + np.arange(2 * REACH + 1)
    return np.where(place[index] == owner[at][:, None], padded[index], np.uint64(0))


class Wanted:
    """What documents are searched for: the bitmap of the benchmark's seeds and the lengths of its short items."""

    def __init__(self, bitmap: np.ndarray, digits: int, short: set[int]):
        self.bitmap, self.digits, self.short = bitmap, digits, short


def _seed_rows(texts: list[str], known: TokenHashes, wanted: Wanted | None):
    """Row number, key, position in its text and surrounding tokens of all seeds of benchmark items (``wanted`` None), or of
    those of documents that the bitmap holds."""
    hashes, length = token_hashes(texts, known)
    owner = np.repeat(np.arange(len(texts)), length)
    start = np.cumsum(length) - length
    for mask in range(len(MASKS) + len(SHORT)):
        n = mask - len(MASKS) + 1  # tokens of a short item
        if n > 0 and wanted is not None and n not in wanted.short:
            continue
        at, key = seeds(hashes, owner, mask)
        if n > 0 and (wanted is None or n < LEAST):
            whole = length[owner[at]] == n
            at, key = at[whole], key[whole]
        if wanted is not None:
            one, two = bit_numbers(key, wanted.digits)
            found = np.flatnonzero(is_set(wanted.bitmap, one))
            found = found[is_set(wanted.bitmap, two[found])]
            at, key = at[found], key[found]
        yield owner[at], key, at - start[owner[at]], around(hashes, owner, at)


def _seed_frame(df: DataFrame, ident: str, kind: str, shared) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = TokenHashes(), shared.value if shared is not None else None
        for batch in batches:
            for part, texts in blocks(batch, limit=2_000_000):
                for row, key, at, near in _seed_rows(texts, known, wanted):
                    # a benchmark text of any length leaves in slices
                    for k in range(0, len(row), 20_000):
                        one = slice(k, k + 20_000)
                        yield pa.RecordBatch.from_arrays([
                            part.column(ident).take(pa.array(row[one])), pa.array(key[one].view(np.int64)),
                            pa.array(at[one].astype(np.int32)),
                            pa.FixedSizeListArray.from_arrays(pa.array(near[one].ravel().view(np.int64)), near.shape[1]).cast(pa.list_(pa.int64())),
                        ], [ident, "key", "at", "around"])

    prepare(df.sparkSession)
    return df.mapInArrow(find, f"{ident} {kind}, {SEEDS}")


def wanted_of(keys: DataFrame, short: set[int]) -> Wanted:
    """The bitmap of the written benchmark seeds; it comes to the driver as words, at most 2 to the MOST_BITS - 6 of them."""
    digits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_SEED * keys.count()).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(bit_numbers(batch.column("key").to_numpy().view(np.uint64), digits))
            yield pa.RecordBatch.from_arrays([
                pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = keys.select("key").mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (digits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Wanted(out.astype("<u8").view(np.uint8), digits, short)


def short_lengths(item_seeds: DataFrame) -> set[int]:
    """Numbers of tokens, below six, that some item has: of their surroundings so many are tokens."""
    held = F.size(F.filter("around", lambda x: x != 0))
    return {r["n"] for r in item_seeds.select(held.alias("n")).filter(F.col("n") <= len(SHORT)).distinct().collect()}


def verify(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of surroundings (text, item): most matches of a window that both hold whole, and where in the surroundings
    the best one starts; 0 where none is near enough."""
    same = (left == right) & (right != 0)
    inside = (left != 0) & (right != 0)
    size = np.where((right != 0).sum(axis=1) < WINDOW, (right != 0).sum(axis=1), WINDOW)
    total = np.concatenate([np.zeros((len(left), 1), int), np.cumsum(same, axis=1)], axis=1)
    whole = np.concatenate([np.zeros((len(left), 1), int), np.cumsum(inside, axis=1)], axis=1)
    best, where = np.zeros(len(left), int), np.zeros(len(left), int)
    for k in range(2 * REACH + 1):
        end = np.minimum(k + size, 2 * REACH + 1)
        rows = np.arange(len(left))
        matches, held = total[rows, end] - total[:, k], whole[rows, end] - whole[:, k]
        # a short item has no room for replacements
        enough = (held == size) & (matches >= np.where(size < WINDOW, size, WINDOW - MAX_SUBS)) & (matches > best)
        best[enough], where[enough] = matches[enough], k
    return best, where


def _matches(docs: DataFrame, ident: str, kind: str, benchmark: DataFrame) -> DataFrame:
    """ident, item_id, start (token of the document), matches, size of every verified hit. ``docs``: ident and text."""
    items = benchmark.filter("text IS NOT NULL")
    item_seeds = written(_seed_frame(items, "item_id", "long", None), "seeds")
    shared = docs.sparkSession.sparkContext.broadcast(wanted_of(item_seeds, short_lengths(item_seeds)))
    hits = _seed_frame(docs.filter("text IS NOT NULL"), ident, kind, shared)
    met = hits.join(item_seeds.select("key", "item_id", F.col("around").alias("theirs")), "key").select(
        ident, "item_id", "at", "around", "theirs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            mine, theirs = (batch.column(c).flatten().to_numpy().view(np.uint64).reshape(n, -1) for c in ("around", "theirs"))
            best, where = verify(mine, theirs)
            good = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([
                batch.column(ident).take(pa.array(good)), batch.column("item_id").take(pa.array(good)),
                pa.array(batch.column("at").to_numpy()[good] + where[good] - REACH, pa.int32()), pa.array(best[good], pa.int32()),
            ], [ident, "item_id", "start", "matches"])

    return met.mapInArrow(check, f"{ident} {kind}, item_id long, start int, matches int")


def contaminations(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """One row per document and item that contaminates it: doc_id, item_id, first_token and last_token (where the first and
    last verified windows start in the document) and matches (equal tokens of the best window)."""
    mine = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    theirs = benchmark.select(quoted(item_id).cast("long").alias("item_id"), quoted(text).cast("string").alias("text"))
    return _matches(mine, "doc_id", "long", theirs).groupBy("doc_id", "item_id").agg(
        F.min("start").alias("first_token"), F.max("start").alias("last_token"), F.max("matches").alias("matches"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates. Texts decide, so ids may be null or repeat."""
    digest = F.md5(F.coalesce(quoted(text).cast("string"), F.lit("")))
    mine = docs.select(digest.alias("digest"), quoted(text).cast("string").alias("text"))
    theirs = benchmark.select(quoted(item_id).cast("long").alias("item_id"), quoted(text).cast("string").alias("text"))
    bad = written(_matches(mine, "digest", "string", theirs).select("digest").distinct(), "contaminated")
    rows = docs.select(packed(docs).alias("row"), digest.alias("digest"))
    few = bad.count() <= BROADCAST_TEXTS
    return unpacked(rows.join(F.broadcast(bad) if few else bad, "digest", "left_anti"), docs.columns, {})
