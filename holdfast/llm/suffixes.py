"""Removal of long strings that occur more than once, by a distributed suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same or another document,
overlaps included; strings are judged on the input. Two equal strings are neighbours once all suffixes are sorted, so the
work is to sort the suffixes that can have an equal neighbour and to leave out those whose answer is known otherwise.

Anchors: among the ``window`` positions that a string of ``length`` bytes begins with, the one whose next GRAM bytes hash
lowest (the first of equal ones) is its anchor. Equal strings have the same anchor place. Neighbouring strings share
anchors, so a document falls into stretches of string starts with one anchor each. A stretch has two hashes: of the bytes
behind its anchor that all its strings hold (``lead``), and of all bytes that its strings cover (``hull``).

1. A lead that occurs once: none of the stretch's strings is repeated. These are most of a clean text.
2. A hull that occurs twice or more: all of the stretch's strings are repeated. This is the inside of copies.
3. Left are stretches whose lead meets other hulls: the ends of copied passages, with one stretch standing for all of an equal
   hull. They are cut into blocks of ``BLOCK`` starts at equal distances from the anchor and judged once more in the same
   way, a block's lead being all bytes that its strings have in common. The bytes of these stretches are written once.
4. Every string start in the blocks still left is a suffix of the array. Suffixes are range-partitioned by their leading tokens (the
   first eight bytes, then two 64-bit digests of the whole string) with splitters that Spark samples, each bucket is sorted by
   multikey quicksort, and suffixes equal to a neighbour are repeated. The first and the last suffix of each bucket are
   compared with those of the buckets beside it, so a string that a third of all documents hold may fill many buckets.

Hashes are told apart by 128 bits at least (lead with hull; the two digests). Counts are aggregated before they are shuffled;
what is joined by a hot lead or hull is dealt out by adaptive execution. A text that repeats itself at short distance merges
into few stretches, of which the first turn stands for all.

Null texts are empty; empty and short texts lose nothing. Rows equal in id and text are copies of each other like any other;
a null id is an id of its own. Texts of any length are read whole, in steps. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import prepare, quoted, written

LENGTH = 400
#: bytes whose hash chooses an anchor
GRAM = 24
#: string starts of one numpy step
STEP = 1 << 20
#: string starts that are judged together in the second turn
BLOCK = 16
#: suffixes of a bucket
BUCKET = 1 << 20
#: suffixes below which a part is sorted by numpy
PART = 1 << 12
#: stretches, or removed runs with their documents, are broadcast up to this many (about 40 bytes each)
BROADCAST_ROWS = 2_000_000


def window_of(length: int) -> int:
    """Starts that one anchor is chosen from: a power of two, so that GRAM bytes behind each stay inside the string."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes or more")
    return 1 << (int(0.64 * length).bit_length() - 1)


# --- stretches --------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the GRAM bytes from each position on, in the upper half."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + words[16:16 + n] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h & np.uint64(0xFFFFFFFF00000000)


def anchors(data: np.ndarray, n: int, window: int) -> np.ndarray:
    """The anchor of each of the first ``n`` starts."""
    h = gram_hashes(data)[:n + window - 1]
    h |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return (h[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(text: bytes, length: int):
    """Arrays (first start, last start, last start of the first turn, anchor, lead, hull, occurrences) of a document, a step at
    a time. Of stretches with equal hashes the first counts all, and those that touch are merged."""
    window, whole = window_of(length), len(text) - length + 1
    lead_bytes, digest = length - window + 1, xxhash.xxh64_intdigest
    for start in range(0, whole, STEP):
        n = min(STEP, whole - start)
        part = text[start:start + n + length - 1] if whole > STEP else text
        anchor = anchors(np.frombuffer(part, np.uint8), n, window)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.append(first[1:], n) - 1
        anchor, view = anchor[first], memoryview(part)
        spots = list(zip(first.tolist(), last.tolist(), anchor.tolist()))
        lead = np.array([digest(view[a:a + lead_bytes]) for _, _, a in spots], np.uint64)
        hull = np.array([digest(view[p:q + length], a - p) for p, q, a in spots], np.uint64)
        yield merged(first + start, last + start, anchor + start, lead, hull)


def merged(first, last, anchor, lead, hull):
    if len(np.unique(hull)) == len(hull):
        return first, last, last, anchor, lead, hull, np.ones(len(hull), np.int64)
    order = np.lexsort([first, hull, lead])
    first, last, anchor, lead, hull = first[order], last[order], anchor[order], lead[order], hull[order]
    new = np.append(True, (lead[1:] != lead[:-1]) | (hull[1:] != hull[:-1]))
    apart = new | np.append(True, first[1:] != last[:-1] + 1)
    head = np.flatnonzero(apart)
    counts = np.zeros(len(first), np.int64)
    starts = np.flatnonzero(new)
    counts[starts] = np.diff(np.append(starts, len(first)))
    return first[head], last[np.append(head[1:], len(first)) - 1], last[head], anchor[head], lead[head], hull[head], counts[head]


def blocks(text: bytes, first: int, until: int, anchor: int, length: int):
    """The same for the blocks of one stretch, whose bytes are ``text``: from its first start on."""
    digest, view, rows = xxhash.xxh64_intdigest, memoryview(text), []
    for k in range((anchor - until) // BLOCK, (anchor - first) // BLOCK + 1):
        top = anchor - BLOCK * k
        p, q = max(first, top - BLOCK + 1), min(until, top)
        rows.append((p, q, q, anchor, digest(view[top - first:top - BLOCK + 1 + length - first], k), digest(view[p - first:q + length - first], anchor - p), 1))
    return rows


KEY = ["ident", "mark"]
SPOT = "first int, last int, until int, anchor int, lead long, hull long, n long"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text as bytes, and ident and mark, which tell documents apart."""
    ident, body = quoted(doc_id).cast("long"), F.coalesce(quoted(text).cast("string"), F.lit(""))
    return docs.select(
        ident.alias("doc_id"), body.cast("binary").alias("text"), F.coalesce(ident, F.lit(0).cast("long")).alias("ident"),
        F.xxhash64(body, ident.isNull()).alias("mark"))


def spot_batch(batch: pa.RecordBatch, rows: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(rows)
    kinds = [np.int32] * 4 + [np.int64] * 3
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(at) for c in KEY), *(pa.array(x.astype(kind)) for x, kind in zip(found, kinds))],
        [*KEY, *(c.split()[0] for c in SPOT.split(", "))])


def stretch_table(source: DataFrame, length: int) -> DataFrame:
    """Every stretch of every document."""

    def find(batches):
        for batch in batches:
            out, rows = [[] for _ in range(7)], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for found in stretches(text, length):
                    for held, values in zip(out, found):
                        held.append(values)
                    rows.append(np.full(len(found[0]), k))
            if rows:
                yield spot_batch(batch, np.concatenate(rows), [np.concatenate(x) for x in out])

    tall = source.select(*KEY, "text").filter(F.octet_length("text") >= length)
    return tall.mapInArrow(find, f"ident long, mark long, {SPOT}")


def sorted_out(table: DataFrame) -> DataFrame:
    """The stretches of a written ``table`` that are ``repeated``, or ``open``: still to be judged."""
    # written, so that the join below has a shuffle of its own on either side and a hot lead can be split
    leads = written(table.groupBy("lead").agg(F.sum("n").alias("n")).filter("n > 1").select("lead"), "repeated_leads")
    kept = written(table.join(leads, "lead").withColumn("pick", F.xxhash64(*KEY, "first")), "led_stretches")
    hulls = written(kept.groupBy("lead", "hull").agg(F.sum("n").alias("times"), F.min("pick").alias("least")), "hulls")
    several = hulls.groupBy("lead").agg(F.count("*").alias("k")).filter("k > 1").select("lead", F.lit(True).alias("several"))
    several = written(several, "shared_leads")
    hulls = written(hulls.join(several, "lead", "left").withColumn("several", F.coalesce("several", F.lit(False))), "judged_hulls")
    stands = F.col("several") & ((F.col("times") == 1) | (F.col("pick") == F.col("least")))
    judged = kept.join(hulls, ["lead", "hull"]).withColumns({"repeated": F.col("times") > 1, "open": stands})
    return written(judged.filter("repeated OR open").drop("pick", "times", "least", "several", "lead", "hull", "n"), "judged_stretches")


def with_rows(source: DataFrame, rows: DataFrame, keys: list[str], size: int, how: str) -> DataFrame:
    """``source`` joined with ``rows``, which are broadcast if there are few."""
    return source.join(F.broadcast(rows) if size <= BROADCAST_ROWS else rows, keys, how)


def segments(source: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """The open stretches of ``judged`` with their bytes, written."""

    def cut_out(batches):
        for batch in batches:
            rows, spots, found = [], [], []
            for k, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist())):
                for x in own:
                    rows.append(k)
                    spots.append((x["first"], x["until"], x["anchor"]))
                    found.append(text[x["first"]:x["until"] + length])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in KEY), *(pa.array(x, pa.int32()) for x in (zip(*spots) if spots else ((), (), ()))), pa.array(found, pa.binary())],
                [*KEY, "first", "until", "anchor", "bytes"])

    # rows equal in id and text have equal stretches
    spots = judged.filter("open").groupBy(*KEY, "first", "until", "anchor").agg(F.lit(1).alias("one"))
    per_text = written(spots.groupBy(*KEY).agg(F.collect_list(F.struct("first", "until", "anchor")).alias("spots")), "open_stretches")
    size = per_text.agg(F.coalesce(F.sum(F.size("spots")), F.lit(0))).first()[0]
    held = with_rows(source.select(*KEY, "text"), per_text, KEY, size, "inner")
    return written(held.mapInArrow(cut_out, "ident long, mark long, first int, until int, anchor int, bytes binary"), "segments")


def block_table(held: DataFrame, length: int) -> DataFrame:
    """Every block of the segments; ``anchor`` is that of the segment, ``segment`` its first start."""

    def find(batches):
        for batch in batches:
            rows, out = [], []
            for k, x in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bytes", "first", "until", "anchor")))):
                found = blocks(*x, length)
                rows += [k] * len(found)
                out += found
            if rows:
                own = spot_batch(batch, np.array(rows), [np.array(x, np.uint64).view(np.int64) for x in zip(*out)])
                yield own.append_column("segment", batch.column("first").take(pa.array(rows)))

    return held.mapInArrow(find, f"ident long, mark long, {SPOT}, segment int")


# --- suffixes ---------------------------------------------------------------------------------------------------------


TOKENS = ["lead", "high", "low"]


def suffixes(held: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """lead, high, low, ident, mark, start: every suffix that starts in an open block of ``judged``; ``held``: the segments."""

    def make(batches):
        for batch in batches:
            rows, starts, eight, digests = [], [], [], []
            for k, (text, first, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bytes", "first", "blocks")))):
                view = memoryview(text)
                for x in blocks:
                    for p in range(x["first"] - first, x["until"] - first + 1):
                        rows.append(k)
                        starts.append(p + first)
                        eight.append(text[p:p + 8])
                        digests.append(xxhash.xxh3_128_digest(view[p:p + length]))
            words = np.frombuffer(b"".join(eight), ">u8").astype(np.uint64), *np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2).T
            # signed numbers in the order of the bytes
            words = [pa.array((w ^ np.uint64(1 << 63)).view(np.int64)) for w in words]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*words, *(batch.column(c).take(at) for c in KEY), pa.array(starts, pa.int32())], [*TOKENS, *KEY, "start"])

    per_segment = judged.filter("open").groupBy(*KEY, "segment").agg(F.collect_list(F.struct("first", "until")).alias("blocks"))
    per_segment = written(per_segment.withColumnRenamed("segment", "first"), "open_blocks")
    size = per_segment.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    found = with_rows(held.select(*KEY, "first", "bytes"), per_segment, [*KEY, "first"], size, "inner")
    return found.mapInArrow(make, "lead long, high long, low long, ident long, mark long, start int")


def multikey(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: three-way partition at a token, the equal part goes on with the next token."""
    out, todo = [], [(np.arange(len(tokens[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == len(tokens):
            out.append(rows)
        elif len(rows) <= PART:
            out.append(rows[np.lexsort([t[rows] for t in tokens[:depth - 1 if depth else None:-1]])])
        else:
            values = tokens[depth][rows]
            pivot = np.sort(values[:: max(1, len(values) // 15)])[7]
            todo += [(rows[values > pivot], depth), (rows[values == pivot], depth + 1), (rows[values < pivot], depth)]
    return np.concatenate(out)


def repeated_starts(found: DataFrame, n: int) -> DataFrame:
    """ident, mark, first, last (both the start) of the ``n`` suffixes of ``found`` that equal another one."""

    def sort_bucket(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        order = multikey([rows.column(c).to_numpy() for c in TOKENS])
        rows = rows.take(pa.array(order)).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in TOKENS])
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(new)))
        inside = np.repeat(sizes > 1, sizes)
        # the first and the last run of equal suffixes meet the neighbouring buckets
        edge = np.zeros(len(new), np.int32)
        edge[0] = 1
        if len(heads) > 1:
            edge[heads[-1]] = 2
        out = rows.append_column("inside", pa.array(inside)).append_column("edge", pa.array(edge))
        yield from out.filter(pa.array(inside | (edge > 0))).to_batches(max_chunksize=1 << 16)

    buckets = max(1, -(-n // BUCKET))
    ranged = found.repartitionByRange(buckets, *TOKENS, *KEY, "start")
    sorted_rows = ranged.mapInArrow(sort_bucket, "lead long, high long, low long, ident long, mark long, start int, inside boolean, edge int")
    judged = written(sorted_rows.withColumn("bucket", F.spark_partition_id()), "suffix_array")
    # two rows a bucket
    beside = Window.orderBy("bucket", "edge")
    token = F.struct(*TOKENS)
    edges = judged.filter("edge > 0").withColumn("meets", (token == F.lag(token).over(beside)) | (token == F.lead(token).over(beside)))
    across = edges.filter("meets AND NOT inside")
    every = judged.filter("inside").select(*KEY, "start").unionByName(across.select(*KEY, "start"))
    return every.select(*KEY, F.col("start").alias("first"), F.col("start").alias("last"))


# --- removal ----------------------------------------------------------------------------------------------------------


def runs_of(firsts: np.ndarray, lasts: np.ndarray, length: int):
    """Starts and ends of the bytes that spans of string starts cover."""
    order = np.argsort(firsts, kind="stable")
    low, high = firsts[order], np.maximum.accumulate(lasts[order] + length)
    new = np.append(True, low[1:] > high[:-1])
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


def removed_runs(spans: DataFrame, length: int) -> DataFrame:
    """ident, mark, starts, ends: the runs of bytes that go, written, a row for each document that loses any."""

    def merge(batches):
        for batch in batches:
            starts, ends = [], []
            for spots in batch.column("spans"):
                found = spots.values
                a, b = runs_of(*(found.field(c).to_numpy().astype(np.int64) for c in ("first", "last")), length)
                starts.append(a)
                ends.append(b)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(starts, longs), pa.array(ends, longs)], [*KEY, "starts", "ends"])

    once = spans.groupBy(*KEY, "first", "last").agg(F.lit(1).alias("one"))
    per_text = once.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return written(per_text.mapInArrow(merge, "ident long, mark long, starts array<long>, ends array<long>"), "removed_runs")


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs of bytes, and kept (the remaining bytes), for every row."""
    prepare(docs.sparkSession)
    source = keyed(docs, doc_id, text)
    judged = sorted_out(written(stretch_table(source, length), "all_stretches"))
    held = segments(source, judged, length)
    finer = sorted_out(written(block_table(held, length), "all_blocks"))
    n = finer.filter("open").agg(F.sum(F.col("until") - F.col("first") + 1).alias("n")).first()["n"] or 0
    spans = repeated_starts(suffixes(held, finer, length), n)
    for found in (judged, finer):
        spans = spans.unionByName(found.filter("repeated").select(*KEY, "first", "last"))
    runs = removed_runs(spans, length)
    size = runs.agg(F.coalesce(F.sum(F.size("starts") + 1), F.lit(0))).first()[0]

    def apply(batches):
        for batch in batches:
            kept, sizes = [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                kept.append(b"".join([text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])]) if starts else text)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("starts"), batch.column("ends"), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "starts", "ends", "kept"])

    none = F.array().cast("array<long>")
    marked = with_rows(source, runs, KEY, size, "left").select(
        "doc_id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"))
    return marked.mapInArrow(apply, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def removed_bytes() -> Column:
    """Of a row of ``without_repeats``."""
    return F.col("n_bytes") - F.octet_length("kept")
