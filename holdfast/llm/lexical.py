"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lowered. The score of a
document is the integer sum that ``weight`` and ``gain`` define, a saturating function of a term's occurrences, weighted by
its rarity.

Index: documents are taken in flushes of about ``FLUSH`` entries, one row each. Inside, documents of like size form blocks.
A block has one Bloom signature per document, cut into slices: a bitmap over its documents for every signature bit. A term
enters once for every level of ``LEVELS`` that its occurrences reach, so the signature says how often it occurs, too, never
too little. Beside it stand the documents' lengths and their exact counts, compressed. The index does not depend on the
queries.

Search: for every query term and level the slices of its bits are joined by AND; the weighted levels of all terms, summed,
are an upper bound of each document's score. A document whose bound is below the k-th best exact score that the task has
met, or not above zero, cannot be in the result; every other one is scored exactly from its counts. Ties at the threshold
are scored. Tasks return their k best rows per query, a window in two steps keeps the k best of all.

Queries are dealt out to blocks of ``ITEM_BLOCK`` texts, one pass over the index each, and their terms are broadcast; so is
nothing that grows with the documents. Document frequencies are counted over all documents, for the terms of a block.

Null and empty texts have no terms: they are neither counted nor found. Items without known terms give no rows. A null
doc_id comes last among equal scores; rows that repeat an id, or all columns, are ranked each; repeated items are answered
each. Texts are read whole, long ones in steps. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import prepare, quoted, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
STEP_CHARS = 1 << 20

#: numbers of occurrences that enter the signature
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128], np.int64)
#: signature entries of one index row
FLUSH = 1_500_000
#: documents of a block, and the fewest before a smaller size opens a new one
BLOCK_DOCS, LEAST_DOCS = 512, 64
#: bits per entry of a block's largest document, slices per entry
BITS_PER_ENTRY, SLICES = 12, 4
#: cells (bits times documents) of a block
BLOCK_CELLS = 1 << 26
#: query texts, and bytes of them, of one pass over the index
ITEM_BLOCK, ITEM_BYTES = 512, 4 << 20
#: groups of tasks whose best rows are merged first
MERGES = 64

INDEX = ("doc_ids array<long>, lengths array<long>, sizes array<int>, block_docs array<int>, block_bits array<int>, signatures binary, "
         "codes binary, counts binary, terms array<string>, document_counts array<long>, n_docs long, n_terms long")


def terms(text: str):
    """Lists of the terms of a text, not lowered yet; a long text is cut behind characters that are in no term."""
    start = 0
    while len(text) - start > STEP_CHARS:
        cut = BREAK.search(text, start + STEP_CHARS)
        if not cut:
            break
        yield TERM.findall(text[start:cut.end()])
        start = cut.end()
    yield TERM.findall(text[start:] if start else text)


def lowered(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(LOWER)


class Codes(dict):
    """Term as written -> number of its lowered form, in order of appearance."""

    def __init__(self) -> None:
        super().__init__()
        self.terms: dict[str, int] = {}

    def __missing__(self, term: str) -> int:
        code = self[term] = self.terms.setdefault(lowered(term), len(self.terms))
        return code


# --- scores -----------------------------------------------------------------------------------------------------------


def weight(n_docs: int, document_count: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * document_count + 1)))


def norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * lengths * n_docs) // n_terms


def gain(occurrences: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * occurrences) // (1000 * occurrences + 12 * norms)


# --- index ------------------------------------------------------------------------------------------------------------


def slices(term_hashes: np.ndarray, level: np.ndarray | int, n_bits: int) -> np.ndarray:
    """Signature bits (entries x SLICES) of terms at levels."""
    h = (term_hashes + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(level).astype(np.uint64) + np.uint64(1)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    each = (low[:, None] + high[:, None] * np.arange(SLICES, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((each * np.uint64(n_bits)) >> np.uint64(32)).astype(np.int64)


def hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in words), np.uint64)


def cut_blocks(entries: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the blocks of documents sorted by falling number of entries."""
    out, first = [], 0
    for k in range(1, len(entries) + 1):
        n = k - first
        largest = int(entries[first]) * BITS_PER_ENTRY
        if k == len(entries) or n == BLOCK_DOCS or (n >= LEAST_DOCS and entries[k] < 0.7 * entries[first]) or largest * (n + 1) > BLOCK_CELLS:
            out.append((first, k))
            first = k
    return out


class Flush:
    """Documents of one index row."""

    def __init__(self) -> None:
        self.known, self.ids, self.docs, self.entries = Codes(), [], [], 0

    def add(self, ident: int | None, text: str) -> None:
        parts = [np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)) for found in terms(text)]
        code, count = np.unique(np.concatenate(parts), return_counts=True)
        if len(code):
            levels = np.searchsorted(LEVELS, count, "right")
            self.ids.append(ident)
            self.docs.append((code, count, levels))
            self.entries += int(levels.sum())

    def batch(self) -> pa.RecordBatch:
        entries = np.array([x.sum() for _, _, x in self.docs])
        order = np.argsort(-entries, kind="stable")
        docs, entries = [self.docs[i] for i in order], entries[order]
        words = list(self.known.terms)
        digest = hashes(words)
        blocks, signatures, n_bits = cut_blocks(entries), [], []
        for first, end in blocks:
            bits = max(64, int(entries[first]) * BITS_PER_ENTRY)
            cells = np.zeros((bits, end - first), bool)
            code, levels = (np.concatenate([d[k] for d in docs[first:end]]) for k in (0, 2))
            doc = np.repeat(np.arange(end - first), [len(d[0]) for d in docs[first:end]])
            at = np.repeat(np.arange(len(code)), levels)
            level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
            rows = slices(digest[code[at]], level, bits)
            for k in range(SLICES):
                cells[rows[:, k], doc[at]] = True
            signatures.append(np.packbits(cells, axis=1).tobytes())
            n_bits.append(bits)
        code, count = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        # codes of a document rise: their steps compress well
        step = np.concatenate([np.diff(d[0], prepend=np.int32(0)) for d in docs]).astype(np.uint32)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        row = {
            "doc_ids": ([self.ids[i] for i in order], longs), "lengths": ([int(d[1].sum()) for d in docs], longs),
            "sizes": ([len(d[0]) for d in docs], ints), "block_docs": ([end - first for first, end in blocks], ints),
            "block_bits": (n_bits, ints), "signatures": (b"".join(signatures), pa.binary()),
            "codes": (squeezed(step), pa.binary()), "counts": (squeezed(count.astype(np.uint32)), pa.binary()),
            "terms": (words, pa.list_(pa.string())), "document_counts": (np.bincount(code, minlength=len(words)), longs),
            "n_docs": (len(docs), pa.int64()), "n_terms": (int(count.sum()), pa.int64()),
        }
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in row.values()], list(row))


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint32)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of ``docs``, one row per flush."""

    def build(batches):
        flush = Flush()
        for batch in batches:
            for ident, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                flush.add(ident, x or "")
                if flush.entries >= FLUSH:
                    yield flush.batch()
                    flush = Flush()
        if flush.ids:
            yield flush.batch()

    prepare(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return written(source.mapInArrow(build, INDEX), "lexical_index")


# --- search -----------------------------------------------------------------------------------------------------------


class Queries:
    """Query texts over one list of terms: numbers and factors (weight times repeats) of each."""

    def __init__(self, keys: list[str], texts: list[str], document_counts: dict[str, int], n_docs: int):
        self.keys, self.at, self.factors = keys, [], []
        known: dict[str, int] = {}
        for x in texts:
            repeats: dict[str, int] = {}
            for t in counted(x):
                if t in document_counts:
                    repeats[t] = repeats.get(t, 0) + 1
            self.at.append(np.array([known.setdefault(t, len(known)) for t in repeats], np.int64))
            self.factors.append(np.array([n * weight(n_docs, document_counts[t]) for t, n in repeats.items()], np.int64))
        self.number, self.hashes = known, hashes(known)


def counted(text: str) -> list[str]:
    return [lowered(t) for found in terms(text or "") for t in found]


def levels_reached(queries: Queries, signature: np.ndarray, n_docs: int) -> np.ndarray:
    """Query terms x documents: number of levels that the signature holds, never too few."""
    out = np.zeros((len(queries.hashes), n_docs), np.int8)
    alive, held = np.arange(len(queries.hashes)), None
    for level in range(len(LEVELS)):
        maps = np.bitwise_and.reduce(signature[slices(queries.hashes[alive], level, len(signature))], axis=1)
        held = maps if held is None else held & maps
        some = held.any(axis=1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        out[alive] += np.unpackbits(held, axis=1, count=n_docs).view(np.int8)
    return out


class Best:
    """The k best (score, doc_id) of each query so far, equal scores by rising id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n)]
        self.least = np.ones(n, np.int64)  # the lowest score that may still enter

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.least[q]
        s, i, n = (np.concatenate([old, new[good]]) for old, new in zip(self.rows[q], (scores, ids, null)))
        order = np.lexsort([i, n, -s])[:self.k]
        self.rows[q] = (s[order], i[order], n[order])
        if len(order) == self.k:
            self.least[q] = s[order[-1]]


def search_row(row: dict, queries: Queries, best: Best, n_docs: int, n_terms: int) -> None:
    """Bounds of all documents of an index row, exact scores of those that may be among the best."""
    lengths, sizes = np.array(row["lengths"], np.int64), np.array(row["sizes"], np.int64)
    norms = norm(lengths, n_docs, n_terms)
    null = np.array([x is None for x in row["doc_ids"]], bool)
    ids = np.array([x or 0 for x in row["doc_ids"]], np.int64)
    number = np.full(len(row["terms"]), -1, np.int64)
    for code, t in enumerate(row["terms"]):
        number[code] = queries.number.get(t, -1)
    steps = np.cumsum(unsqueezed(row["codes"], int(sizes.sum())), dtype=np.int64)
    ends = np.cumsum(sizes)
    counts, starts = unsqueezed(row["counts"], int(sizes.sum())), ends - sizes
    first = offset = 0
    for n, n_bits in zip(row["block_docs"], row["block_bits"]):
        width = -(-n // 8)
        signature = np.frombuffer(row["signatures"], np.uint8, n_bits * width, offset).reshape(n_bits, width)
        offset += n_bits * width
        reached = levels_reached(queries, signature, n)
        here = slice(first, first + n)
        most = np.minimum(np.concatenate([[0], LEVELS[1:] - 1, [np.iinfo(np.int64).max]])[:, None], lengths[here][None, :])
        bounds = gain(most, norms[here])
        doc = np.arange(n)
        chosen = []
        for q, (at, factors) in enumerate(zip(queries.at, queries.factors)):
            upper = factors @ bounds[reached[at], doc] if len(at) else np.zeros(n, np.int64)
            chosen.append(np.flatnonzero(upper >= best.least[q]))
        some = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        exact = np.zeros((len(some), len(queries.hashes)), np.int64)
        for k, d in enumerate((some + first).tolist()):
            low, high = starts[d], ends[d]
            term = number[steps[low:high] - (steps[low - 1] if low else 0)]
            exact[k, term[term >= 0]] = counts[low:high][term >= 0]
        for q, docs in enumerate(chosen):
            if len(docs):
                found = exact[np.searchsorted(some, docs)][:, queries.at[q]]
                best.add(q, gain(found, norms[docs + first][:, None]) @ queries.factors[q], ids[docs + first], null[docs + first])
        first += n


def search(found: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of the index ``found`` for every row of ``items``."""
    spark = prepare(found.sparkSession)
    asked = items.select(quoted(item_id).alias("item_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    asked = asked.withColumn("key", F.md5("text"))
    distinct = written(asked.groupBy("key").agg(F.first("text").alias("text")), "lexical_items")
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    whole = found.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    passes = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["bytes"] // ITEM_BYTES))
    best = None
    for number in range(passes):
        part = distinct.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == number)
        more = _search_block(found, part.collect(), k, whole["n_docs"] or 0, whole["n_terms"] or 0)
        best = more if best is None else best.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["key", "merge"], ["key"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return asked.select("item_id", "key").join(best, "key").select("item_id", "rank", "doc_id", "score")


def _search_block(found: DataFrame, rows: list, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """key, doc_id, score, merge: the ``k`` best rows of every task for some query texts."""
    spark = found.sparkSession
    own = sorted({t for r in rows for t in counted(r["text"])})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in own], "term string"))
    each = found.select(F.explode(F.arrays_zip("terms", "document_counts")).alias("x")).select(F.col("x.terms").alias("term"), "x.document_counts")
    # at most the terms of the block
    counts = each.join(wanted, "term").groupBy("term").agg(F.sum("document_counts").alias("n")).collect()
    queries = Queries([r["key"] for r in rows], [r["text"] for r in rows], {r["term"]: r["n"] for r in counts}, n_docs)
    sent = spark.sparkContext.broadcast(queries)

    def look(batches):
        queries = sent.value
        best = Best(len(queries.keys), k)
        for batch in batches:
            for row in range(batch.num_rows):
                search_row(batch.slice(row, 1).to_pylist()[0], queries, best, n_docs, n_terms)
        key = [x for q, x in enumerate(queries.keys) for _ in best.rows[q][0]]
        scores, ids, null = (np.concatenate([r[c] for r in best.rows]) if best.rows else np.zeros(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.string()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(scores, pa.int64())], ["key", "doc_id", "score"])

    columns = [c.split()[0] for c in INDEX.split(", ") if c.split()[0] not in ("document_counts", "n_docs", "n_terms")]
    out = found.select(*columns).mapInArrow(look, "key string, doc_id long, score long")
    return out.withColumn("merge", F.spark_partition_id() % MERGES)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over a new index of ``docs`` (doc_id, text) for ``items`` (item_id, text)."""
    return search(index(docs), items, k)
