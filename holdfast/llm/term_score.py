"""Cross-entropy difference scores of documents under a target and a background n-gram model of all their words.

Terms of a lower-cased text: runs of letters, digits and marks; every other character that is not blank on its own; of runs
in scripts without blanks (Han, Kana, Thai, Lao, Khmer, Burmese) every three characters in a row, a shorter run whole; and
the text's end. Both models are over one vocabulary, all terms of the corpus. The background model counts all documents, the
target model those that ``targets`` names. A score is the mean over a document's terms of the target loss minus the background
loss: the lower, the more it is like the target.

``order`` 1: a term's probability is its count with ``ALPHA`` added to every count. ``order`` 2: the probability of a term
behind another is the count of the pair, with ``BACKOFF`` occurrences added that are dealt like the first model; what comes
before a text's first term is its end, so a term is as often a first member of pairs as it occurs.

Nothing is capped. Documents go in blocks of about ``BLOCK_CHARS`` code points, written as the codes of their terms. Each block
sends its distinct terms and pairs with their counts, cut by ranges of their hashes, to the tasks that add up a range over all
blocks; the sums come back in the order in which the block sent the keys, so a frequent term or pair costs one key per block.
Terms are told apart by 63 bits of a hash, and so are pairs. A null or empty text has one term, its end; null texts are not
counted. Repeated rows are counted and scored each. Target ids that no document has, null ids and repeated ids change nothing.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import prepare, quoted, written

#: added to every count
ALPHA = 0.5
#: occurrences of the term model that are added to what is counted behind a term
BACKOFF = 5.0
#: terms of the corpus for each range of hashes, whose distinct terms and pairs one task adds up
RANGE_TERMS = 1_000_000
#: code points of one block, a document at least
BLOCK_CHARS = 4_000_000
#: bytes of one Arrow batch: a block's row has about this many, and a task works on one block at a time
BATCH_BYTES = 4 << 20
#: target ids are broadcast up to this many (8 bytes each)
BROADCAST_IDS = 1_000_000
#: scripts without blanks between words
DENSE = "฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
#: marks that Python does not count as letters
MARKS = "̀-ͯऀ-෿"
PLAIN = re.compile(rf"[\w{MARKS}]+|\S")
MIXED = re.compile(rf"[{DENSE}]+|(?:[^\W{DENSE}]|[{MARKS}])+|\S")
DENSE_RUN = re.compile(f"[{DENSE}]")
END = ""


def terms(text: str) -> list[str]:
    text = text.lower()
    if text.isascii() or not DENSE_RUN.search(text):
        return [*PLAIN.findall(text), END]
    out = []
    for x in MIXED.findall(text):
        out += [x[k:k + 3] for k in range(max(1, len(x) - 2))] if DENSE_RUN.match(x) else [x]
    return [*out, END]


BAGS = ("block string, doc_ids array<long>, sizes array<int>, whole array<boolean>, wanted array<boolean>, codes binary, "
        "terms binary, n long, n_target long")


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: the bytes that are mostly zero lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Block:
    """Documents as codes of their terms, laid end to end."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.codes, self.whole, self.wanted, self.chars = [], [], [], [], 0

    def add(self, ident: int | None, text: str | None, target: bool) -> None:
        known = self.known
        self.ids.append(ident)
        self.codes.append(np.array([known.setdefault(t, len(known)) for t in terms(text or "")], np.int32))
        self.whole.append(text is not None)
        self.wanted.append(text is not None and target)
        self.chars += len(text or "")

    def batch(self) -> pa.RecordBatch:
        keys = np.array([xxhash.xxh64_intdigest(t) for t in self.known], np.uint64)
        sizes = [len(x) for x in self.codes]
        rows = [uuid.uuid4().hex, self.ids, sizes, self.whole, self.wanted, planes(np.concatenate(self.codes)), keys.tobytes(),
                sum(n for n, flag in zip(sizes, self.whole) if flag), sum(n for n, flag in zip(sizes, self.wanted) if flag)]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(),
                 pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(rows, kinds)], [x.split()[0] for x in BAGS.split(", ")])


class Grams:
    """A written block's terms and, for order 2, its pairs: the same keys in the same order whenever it is read."""

    def __init__(self, row: dict, order: int) -> None:
        self.sizes = np.array(row["sizes"], np.int64)
        self.codes = unplaned(row["codes"], np.int32)
        hashes = np.frombuffer(row["terms"], np.uint64)
        self.vocabulary = len(hashes)
        keys = hashes & ~np.uint64(1)
        if order > 1:
            # every text ends in the same term, which is what the next text's first term stands behind
            both = np.roll(self.codes, 1).astype(np.int64) * self.vocabulary + self.codes
            pairs, self.pair = np.unique(both, return_inverse=True)
            del both
            self.pair = self.pair.astype(np.int32)
            self.first, self.second = (x.astype(np.int32) for x in np.divmod(pairs, self.vocabulary))
            x = hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.second]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            keys = np.concatenate([keys, (x ^ (x >> np.uint64(29))) | np.uint64(1)])
        self.place = np.argsort(keys, kind="stable")
        self.keys = keys[self.place]

    def counts(self, flags: list[bool]) -> np.ndarray:
        """Occurrences of the keys in the flagged documents."""
        weights = np.repeat(np.array(flags, bool), self.sizes).astype(np.float64)
        n = np.bincount(self.codes, weights=weights, minlength=self.vocabulary)
        if len(self.keys) > self.vocabulary:
            n = np.concatenate([n, np.bincount(self.pair, weights=weights, minlength=len(self.first))])
        return n[self.place].astype(np.int64)

    def loss(self, counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """The loss of every term of the block, given the corpus' counts of the keys."""
        n = np.empty(len(counts))
        n[self.place] = counts
        n_terms, n_pairs = n[:self.vocabulary], n[self.vocabulary:]
        share = (n_terms + ALPHA) / (total + ALPHA * vocabulary)
        if not len(n_pairs):
            return -np.log(share)[self.codes]
        return -np.log((n_pairs + BACKOFF * share[self.second]) / (n_terms[self.first] + BACKOFF))[self.pair]


def bags(docs: DataFrame) -> DataFrame:
    """One row per block of ``docs`` (doc_id, text, target)."""

    def pack(batches):
        block = Block()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "target"))):
                block.add(*row)
                if block.chars >= BLOCK_CHARS:
                    yield block.batch()
                    block = Block()
        if block.ids:
            yield block.batch()

    return docs.select("doc_id", "text", "target").mapInArrow(pack, BAGS)


def added(table: pa.Table) -> pa.Table:
    """The counts of one range's keys added up over its blocks. The columns are unpacked one at a time and one block at a time,
    so that a task holds little more than the range as it was sent."""
    keys, ends = _laid_out(table.column("keys"), np.uint64, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.diff(keys, prepend=~keys[:1]) != 0
    new_terms = int((fresh & (keys & np.uint64(1) == 0)).sum())
    del keys
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - 1
    del order, fresh
    columns = {"block": table.column("block"), "part": table.column("part")}
    for name in ("n", "n_target"):
        # whole numbers below 2^53
        total = np.bincount(at, weights=_laid_out(table.column(name), np.int64, np.float64)[0]).astype(np.int64)
        columns[name] = pa.array((planes(total[at[low:high]]) for low, high in zip([0, *ends], ends)), pa.binary(), size=len(ends))
    return pa.table({**columns, "new_terms": pa.array([new_terms] + [0] * (len(ends) - 1), pa.int64())})


def _laid_out(column: pa.ChunkedArray, kind: type, out: type) -> tuple[np.ndarray, list[int]]:
    """The rows' numbers end to end, steps summed up if they are keys, and where each row ends."""
    size = np.dtype(kind).itemsize
    ends = np.cumsum([len(x.as_buffer()) // size for x in column]).tolist()
    values = np.empty(ends[-1], out)
    for x, low, high in zip(column, [0, *ends], ends):
        part = unplaned(x.as_buffer(), kind)
        values[low:high] = np.cumsum(part, dtype=np.uint64) if kind is np.uint64 else part
    return values, ends


def sums(packed: DataFrame, order: int, ranges: int) -> DataFrame:
    """For every block and range of hashes the corpus' counts of the block's keys in their order; one row of a range also holds
    how many distinct terms the range has."""

    def deal(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                grams = Grams(row, order)
                n, n_target = grams.counts(row["whole"]), grams.counts(row["wanted"])
                ends = np.searchsorted((grams.keys >> np.uint64(33)) * np.uint64(ranges) >> np.uint64(31), np.arange(ranges + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[k], ends[k + 1])
                    steps = np.diff(grams.keys[at], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pylist([{
                        "block": row["block"], "part": int(k), "keys": planes(steps), "n": planes(n[at]), "n_target": planes(n_target[at])}], dealt)
                del grams, n, n_target

    dealt = pa.schema([("block", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("n_target", pa.binary())])
    sent = packed.select("block", "sizes", "whole", "wanted", "codes", "terms").mapInArrow(
        deal, "block string, part int, keys binary, n binary, n_target binary")
    return sent.groupBy("part").applyInArrow(lambda key, table: added(table), "block string, part int, n binary, n_target binary, new_terms long")


def score(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 1) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per term) and score, for every row of ``docs``."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    prepare(docs.sparkSession, BATCH_BYTES)
    wanted = targets.select(quoted(doc_id).cast("long").alias("doc_id"), F.lit(True).alias("target")).filter("doc_id IS NOT NULL").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    source = source.join(wanted, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    packed = written(bags(source), "bags")
    size = packed.agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).first()
    model = written(sums(packed, order, 1 + (size["n"] or 0) // RANGE_TERMS), "term_counts")
    vocabulary = model.agg(F.sum("new_terms").alias("v")).first()["v"]

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams(row, order)
        right = right.sort_by("part")
        owner = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
        means = []
        for name in ("n_target", "n"):
            counts = np.concatenate([unplaned(x, np.int64) for x in right.column(name).to_pylist()])
            means.append(np.bincount(owner, weights=grams.loss(counts, size[name], vocabulary)) / grams.sizes)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(grams.sizes), "target_loss": pa.array(means[0]),
            "background_loss": pa.array(means[1]), "score": pa.array(means[0] - means[1])})

    sides = packed.select("block", "doc_ids", "sizes", "codes", "terms").groupBy("block").cogroup(
        model.select("block", "part", "n", "n_target").groupBy("block"))
    return sides.applyInArrow(judge, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
