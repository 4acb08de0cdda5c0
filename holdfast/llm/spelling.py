"""Groups of spelling variants: words one edit apart, each led to a much more frequent one.

Words: maximal runs of the letters ``RUN`` names, A-Z lowered. One run in 31 of a document (by the CRC32 of
``<doc_id>:<run>``) loses one code point, which plants spelling mistakes that can be counted. Words have at least
``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences in all documents.

Neighbours: two words are near if one inserted, deleted or replaced code point leads from one to the other. Each word
generates its deletions and those replacements whose new letter is the greater one, so every near pair is generated once,
from one side. The generated spellings probe Bloom filters of 512-bit blocks, one filter per word length, as 64-bit
polynomial hashes that change by one multiplication per edit; no string is built. Only positives become rows, which meet
the vocabulary in an exact join that removes the false ones.

The filters are broadcast. They take 16 bits a word; when they need more than ``filter_bytes``, they are broadcast in
rounds of at most that size, each round probing the blocks it holds. A false positive costs one row, a near pair is never
missed.

A word's form is its most frequent near word (ties: the smallest in code-point order) if that has at least ``FACTOR`` times
its occurrences; the root follows forms to the last one by pointer doubling. Each form is ten times as frequent as the one
before, so a chain has 18 steps at most.

Null and empty texts have no words. A null id is an empty string in the digest. Repeated rows count each. Texts of any
length are read whole, in one pass with a bounded dictionary. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import prepare, quoted, written

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: shorter runs make no words
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: distinct words a task holds before it returns their counts
HELD_WORDS = 400_000
#: code points of a text that are searched in one step, up to the end of a run
STEP_CHARS = 1 << 22

BITS_PER_WORD, BLOCK_WORDS, PROBES = 16, 8, 6
#: blocks of one filter row, 16 KB
PIECE_BLOCKS = 256
#: bytes of filters that one round broadcasts
FILTER_BYTES = 64 << 20
#: words of this length and more share a filter
LONG = 64
#: words of a probing task, words that are probed together, and letters of one numpy step
TASK_PROBES, HELD_PROBES, STEP_CELLS = 32_768, 16_384, 1 << 21

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


# --- vocabulary -------------------------------------------------------------------------------------------------------


def runs(text: str):
    """The runs of a text; a long text is cut behind a character that is in no run."""
    start = 0
    while len(text) - start > STEP_CHARS:
        cut = re.compile(r"[^A-Za-zÀ-ÿ]").search(text, start + STEP_CHARS)
        if not cut:
            break
        yield from RUN.findall(text[start:cut.end()])
        start = cut.end()
    yield from RUN.findall(text[start:] if start else text)


def planted(doc_id: str, run: str) -> str:
    """The run, lowered, without the code point its digest deletes."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 31:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n for all words of ``docs``."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for ident, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for run, n in Counter(runs(x or "")).items():
                    word = planted(ident or "", run)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    prepare(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("string").alias("doc_id"), quoted(text).cast("string").alias("text"))
    counts = source.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# --- hashes -----------------------------------------------------------------------------------------------------------


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2^64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(BASE)
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def by_length(words: list[str]):
    """(positions in the list, code points as a matrix) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for m in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == m)
        for low in range(0, len(at), max(1, STEP_CELLS // m)):
            part = at[low:low + max(1, STEP_CELLS // m)]
            codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), "<u4")
            yield part, codes.reshape(-1, m).astype(np.uint64)


def shard_of(length):
    return np.minimum(length, LONG)


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def bits_of(h: np.ndarray, j: int) -> np.ndarray:
    """Bit (0 to 511) that probe j of a hash sets in its block."""
    return (mixed(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(9 * j)) & np.uint64(511)


# --- filters ----------------------------------------------------------------------------------------------------------


class Filters:
    """Blocks of some lengths: shard -> (number of blocks in all, first block held, bits held)."""

    def __init__(self, held: dict[int, tuple[int, int, np.ndarray]]):
        self.held = held

    def positives(self, shard: int, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be words of that length."""
        if shard not in self.held:
            return np.zeros(0, np.int64)
        total, first, bits = self.held[shard]
        h = mixed(h)
        block = block_of(h, total).astype(np.int64) - first
        at = np.flatnonzero((block >= 0) & (block < len(bits) // BLOCK_WORDS))
        block, h = block[at], mixed(h[at] + np.uint64(0x632BE59BD9B4E019))
        for j in range(PROBES):
            bit = (h >> np.uint64(9 * j)) & np.uint64(511)
            hit = (bits[block * BLOCK_WORDS + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            at, block, h = at[hit], block[hit], h[hit]
        return at


def pieces(words: DataFrame, n_blocks: dict[int, int]) -> DataFrame:
    """shard, piece, bits: the filters, PIECE_BLOCKS blocks a row."""

    def place(batches):
        for batch in batches:
            found = batch.column("word").to_pylist()
            out = np.zeros((3, len(found)), np.int64)
            for at, codes in by_length(found):
                shard = int(shard_of(codes.shape[1]))
                h = mixed((codes * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))
                out[0, at], out[1, at], out[2, at] = shard, block_of(h, n_blocks[shard]), h.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (out[0], out[1] // PIECE_BLOCKS, out[1] % PIECE_BLOCKS, out[2])], ["shard", "piece", "block", "h"])

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        shard, piece = key[0].as_py(), key[1].as_py()
        bits = np.zeros(BLOCK_WORDS * min(PIECE_BLOCKS, n_blocks[shard] - piece * PIECE_BLOCKS), np.uint64)
        block, h = group.column("block").to_numpy(), group.column("h").to_numpy().view(np.uint64)
        for j in range(PROBES):
            bit = bits_of(h, j)
            np.bitwise_or.at(bits, block * BLOCK_WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return pa.table({"shard": [shard], "piece": [piece], "bits": [bits.tobytes()]})

    placed = words.select("word").mapInArrow(place, "shard long, piece long, block long, h long")
    return placed.groupBy("shard", "piece").applyInArrow(fill, "shard long, piece long, bits binary")


def rounds(n_blocks: dict[int, int], filter_bytes: int) -> list[list[tuple[int, int, int]]]:
    """(shard, first piece, end piece) lists, each of at most ``filter_bytes``, one piece at least."""
    out, room = [[]], 0
    most = max(1, filter_bytes // (PIECE_BLOCKS * BLOCK_WORDS * 8))
    for shard, n in sorted(n_blocks.items()):
        first, end = 0, -(-n // PIECE_BLOCKS)
        while first < end:
            if room == most:
                out.append([])
                room = 0
            take = min(end - first, most - room)
            out[-1].append((shard, first, first + take))
            first, room = first + take, room + take
    return out


# --- probes -----------------------------------------------------------------------------------------------------------


def probe(words: list[str], filters: Filters, alphabet: np.ndarray):
    """(position in the list, generated spelling) of all deletions and raising replacements that the filters may hold."""
    for at, codes in by_length(words):
        rows, m = codes.shape
        weight = powers(m)
        terms = codes * weight
        whole = terms.sum(axis=1, dtype=np.uint64)
        shard, shorter = int(shard_of(m)), int(shard_of(m - 1))
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        before = np.zeros(rows, np.uint64)
        for i in range(m):
            if m > MIN_LENGTH and shorter in filters.held:
                # what follows moves down by one place; of equal letters in a row one is deleted
                h = before + (whole - before - terms[:, i]) * inverse
                new = np.ones(rows, bool) if i == 0 else codes[:, i] != codes[:, i - 1]
                own = np.flatnonzero(new)
                for k in own[filters.positives(shorter, h[own])].tolist():
                    word = words[at[k]]
                    yield at[k], word[:i] + word[i + 1:]
            if shard in filters.held:
                row, letter = np.nonzero(alphabet[None, :] > codes[:, i][:, None])
                h = whole[row] + (alphabet[letter] - codes[row, i]) * weight[i]
                for k in filters.positives(shard, h).tolist():
                    word = words[at[row[k]]]
                    yield at[row[k]], word[:i] + chr(int(alphabet[letter[k]])) + word[i + 1:]
            before += terms[:, i]


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n: every near pair of the written vocabulary ``words`` (word, n) once."""
    spark = words.sparkSession
    # at most LONG rows, and at most as many letters as the pattern has
    counts = {r["shard"]: r["k"] for r in words.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("shard")).agg(F.count("*").alias("k")).collect()}
    letters = [r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()]
    alphabet = np.array(sorted(ord(c) for c in letters if c), np.uint64)
    n_blocks = {shard: -(-k * BITS_PER_WORD // (BLOCK_WORDS * 64)) for shard, k in counts.items()}
    bits = written(pieces(words, n_blocks), "spelling_filters")

    def one_round(part: list[tuple[int, int, int]]) -> DataFrame:
        held = {}
        for shard, first, end in part:
            rows = bits.filter((F.col("shard") == shard) & (F.col("piece") >= first) & (F.col("piece") < end)).collect()
            size = min(end * PIECE_BLOCKS, n_blocks[shard]) - first * PIECE_BLOCKS
            array = np.zeros(size * BLOCK_WORDS, np.uint64)
            for r in rows:
                start = (r["piece"] - first) * PIECE_BLOCKS * BLOCK_WORDS
                array[start:start + len(r["bits"]) // 8] = np.frombuffer(r["bits"], np.uint64)
            held[shard] = (n_blocks[shard], first * PIECE_BLOCKS, array)
        sent = spark.sparkContext.broadcast(held)

        def found(batches):
            filters = Filters(sent.value)
            words, ns = [], []
            for batch in batches:
                words += batch.column("word").to_pylist()
                ns += batch.column("n").to_pylist()
                if len(words) >= HELD_PROBES:
                    yield from answers(words, ns, filters)
                    words, ns = [], []
            yield from answers(words, ns, filters)

        def answers(words, ns, filters):
            hits, spelled = [], []
            for k, spelling in probe(words, filters, alphabet):
                hits.append(k)
                spelled.append(spelling)
                if len(hits) == HELD_PROBES:
                    yield batch_of(words, ns, hits, spelled)
                    hits, spelled = [], []
            yield batch_of(words, ns, hits, spelled)

        # the words of a vocabulary fill few files, but take long to probe
        dealt = words.select("word", "n").repartition(max(1, sum(counts.values()) // TASK_PROBES), "word")
        return dealt.mapInArrow(found, "word string, n long, near string")

    def batch_of(words, ns, hits, spelled) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in hits], pa.string()), pa.array([ns[k] for k in hits], pa.int64()), pa.array(spelled, pa.string())], ["word", "n", "near"])

    probes = None
    for part in rounds(n_blocks, filter_bytes):
        more = one_round(part)
        probes = more if probes is None else probes.unionByName(more)
    return probes.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


# --- groups -----------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows of ``forms`` (word, form): forms followed to the last."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left")
        if moved.filter("next IS NOT NULL").isEmpty():
            return now
        now = written(moved.select("word", F.coalesce("next", "root").alias("root")), "spelling_roots")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root for every word of ``docs``."""
    words = written(vocabulary(docs, doc_id, text), "spelling_words")
    pairs = written(near_pairs(words, filter_bytes), "spelling_pairs")
    both = pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    leads = -F.col("best.order") >= FACTOR * F.col("n")
    graded = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.order")).alias("form_n"))
    graded = written(graded, "spelling_forms")
    found = roots(graded.filter("form IS NOT NULL"))
    return graded.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
