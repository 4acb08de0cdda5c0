"""SimHash near-duplicate groups by a self-join of a binary trie.

Fingerprints: ASCII capitals are lowered, words are runs of anything but ASCII blanks, shingles of ``width`` words are
hashed (XXH64 of UTF-8, seed 42); a bit is set where more than half of the hashes, repeats counted, set it. A text of fewer
words has its whole sequence as only shingle; a text without words, or null, has fingerprint zero and links like any other.

Join: distinct fingerprints form a binary trie. Node pairs are walked together from the root, the differing bits so far are
added up, and a pair is pruned when they exceed the budget. The first levels of the walk are a DataFrame ``explode``: every
fingerprint goes to the node pairs its prefix belongs to (its own prefix, and the prefixes within the budget). Pairs that
hold too many rows are walked further down in the same way until every pair fits into one task; below, each task walks its
pair of subtrees in numpy. A task returns a spanning forest of its links, never all pairs of a dense group.

Groups: links joined to components by alternating large-star and small-star steps. Equal fingerprints are one node, so
copies cost one row each and no pairs. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import packed, prepare, quoted, unpacked, written
from holdfast.operators.stable import stable

BITS = 64
SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: shingles whose bits are counted in one step
STEP = 1 << 15
#: bits of the prefix that one further level of the distributed walk adds
LEVEL_BITS = 4
#: node pairs that one numpy step holds
FRONTIER = 1 << 18
#: fingerprints or edges that one partition is meant for
TASK_ROWS = 1 << 16


def shingle_hashes(text: str, width: int):
    """Arrays of shingle hashes of a text, STEP shingles at a time, so that a long text needs little memory."""
    tail: list[str] = []
    some = False
    digest = xxhash.xxh64_intdigest
    for chunk in word_chunks(text):
        words = tail + chunk
        if len(words) >= width:
            some = True
            grams = zip(*(words[k:] for k in range(width)))
            yield np.fromiter((digest(" ".join(g), SEED) for g in grams), np.uint64, len(words) - width + 1)
            words = words[len(words) - width + 1:] if width > 1 else []
        tail = words
    if not some and tail:
        yield np.array([digest(" ".join(tail), SEED)], np.uint64)


def word_chunks(text: str):
    """Lists of the words of a text, all at once or STEP at a time if it is long."""
    text = text.translate(LOWER)
    return [WORD.findall(text)] if len(text) < 1 << 20 else _word_chunks(text, STEP)


def _word_chunks(text: str, size: int):
    chunk: list[str] = []
    for m in WORD.finditer(text):
        chunk.append(m.group())
        if len(chunk) == size:
            yield chunk
            chunk = []
    yield chunk


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        n += len(hashes)
        for start in range(0, len(hashes), STEP):
            part = hashes[start:start + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (MD5 of the text) and fp (the fingerprint's bits as a long) for every row."""

    def score(batches):
        for batch in batches:
            values = np.array([fingerprint(x or "", width) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(values.view(np.int64))], ["doc_id", "digest", "fp"])

    prepare(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"), quoted(text).cast("string").alias("text"))
    return source.mapInArrow(score, "doc_id long, digest string, fp long")


def text_digest(text: str) -> Column:
    return F.md5(F.coalesce(quoted(text).cast("string"), F.lit("")))


# --- the walk over node pairs, distributed levels ---------------------------------------------------------------------


def masks(bits: int, errors: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``errors`` set."""
    out = [0]
    for _ in range(errors):
        out = sorted({m | 1 << k for m in out for k in range(bits)} | set(out))
    return out


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def _long_array(values: list[int]) -> Column:
    return F.lit(np.array(values, dtype=np.int64))


def _pair(own: Column, other: Column, side: Column | None = None) -> list[Column]:
    return [F.least(own, other).alias("a"), F.greatest(own, other).alias("b"),
            (F.when(own <= other, 0).otherwise(1) if side is None else side).cast("int").alias("side")]


def start_pairs(nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Every fingerprint in every node pair of ``depth`` bits whose prefixes differ in at most ``budget`` bits."""
    spread = nodes.select("fp", _prefix(depth).alias("own"), F.explode(_long_array(masks(depth, budget))).alias("m"))
    return spread.select(*_pair(F.col("own"), F.col("own").bitwiseXOR(F.col("m"))), "fp")


def deeper_pairs(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """The same rows one level down: LEVEL_BITS more bits of each prefix, pairs beyond the budget pruned."""
    left = budget - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    low = _prefix(depth + LEVEL_BITS).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1).cast("long"))
    by_left = F.element_at(F.array(*[_long_array(masks(LEVEL_BITS, e)) for e in range(budget + 1)]), left + 1)
    spread = rows.select("a", "b", "side", "fp", low.alias("low"), F.explode(by_left).alias("m"))
    mine = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))
    theirs = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    own = F.shiftleft(mine, LEVEL_BITS).bitwiseOR(F.col("low"))
    other = F.shiftleft(theirs, LEVEL_BITS).bitwiseOR(F.col("low").bitwiseXOR(F.col("m")))
    return spread.select(*_pair(own, other), "fp")


def trie_links(nodes: DataFrame, budget: int = 2, node_rows: int = 8192, head: tuple[int, int] = (0, 0), joined=None) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``nodes`` (one column fp, distinct) within ``budget`` bits.

    Every link is found; those that a task can tell to be implied by others of its own are left out. With ``head`` = (bits,
    errors) only pairs are followed whose first bits differ in so many at most. ``joined`` (rows, depth, budget) replaces
    what the tasks return."""
    joined = joined or _joined
    deepest = max(0, math.ceil(math.log2(max(1, nodes.count()) / node_rows)))
    at = lambda d: head[1] if d <= head[0] else budget
    # behind the head a level at a time: its pairs are few, all prefixes of the whole budget would not be
    depth = min(deepest, head[0]) if head[0] else deepest
    rows, done = start_pairs(nodes, depth, at(depth)), []
    while depth + LEVEL_BITS <= deepest:
        rows, depth = deeper_pairs(rows, depth, at(depth + LEVEL_BITS)), depth + LEVEL_BITS
    while True:
        # a self pair of a full node shrinks by a level at least; distinct fingerprints end at 64 bits
        sizes = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > 8 * node_rows)
        # a few node pairs at most
        full = stable(sizes.select("a", "b").coalesce(nodes.sparkSession.sparkContext.defaultParallelism))
        if depth + LEVEL_BITS > BITS or full.isEmpty():
            done.append(joined(rows, depth, budget))
            break
        done.append(joined(rows.join(full, ["a", "b"], "left_anti"), depth, budget))
        rows = stable(deeper_pairs(rows.join(full, ["a", "b"], "left_semi"), depth, at(depth + LEVEL_BITS)))
        depth += LEVEL_BITS
    links = done[0]
    for more in done[1:]:
        links = links.unionByName(more)
    return links


def _joined(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    def one_pair(key: tuple, group: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        side, fp = group.column("side").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        u, v = walk(left, None if a == b else right, depth, (a ^ b).bit_count(), budget)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return rows.groupBy("a", "b").applyInArrow(one_pair, "u long, v long")


# --- the walk below, inside a task ------------------------------------------------------------------------------------


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int):
    """Spanning links between two sorted subtrees (``right`` None: within one), both ``depth`` bits below the root."""
    fps = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(fps))
    shift = 0 if right is None else len(left)
    other = left if right is None else right
    n, m = len(left), len(other)
    if n and m:
        todo = [(depth, np.array([[0, n, 0, m, errors, right is None]], np.int64))]
        while todo:
            level, pairs = todo.pop()
            # a pair of few leaves is compared directly
            few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 32
            if level == BITS:
                few[:] = True
            x, y = _leaves(pairs[few])
            near = np.bitwise_count(left[x] ^ other[y]) <= budget
            unite(parent, x[near], y[near] + shift)
            pairs = pairs[~few]
            if len(pairs):
                below = _children(left, other, pairs, level, budget)
                todo += [(level + 1, below[k:k + FRONTIER]) for k in range(0, len(below), FRONTIER)]
    linked = np.flatnonzero(roots(parent, np.arange(len(fps))) != np.arange(len(fps)))
    return fps[linked], fps[roots(parent, linked)]


def _leaves(pairs: np.ndarray):
    """Index pairs of all leaves below small node pairs."""
    wide = pairs[:, 3] - pairs[:, 2]
    size = (pairs[:, 1] - pairs[:, 0]) * wide
    at = np.repeat(np.arange(len(pairs)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return pairs[at, 0] + k // wide[at], pairs[at, 2] + k % wide[at]


def _cut(fps: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where bit ``level`` turns from 0 to 1 inside each node."""
    ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
    return high - (ones[high] - ones[low])


def _children(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, level: int, budget: int) -> np.ndarray:
    la, ha, lb, hb, errors, same = pairs.T
    ca, cb = _cut(left, la, ha, level), _cut(right, lb, hb, level)
    none = np.zeros_like(same)
    out = np.concatenate([
        np.stack([la, ca, lb, cb, errors, same], 1), np.stack([ca, ha, cb, hb, errors, same], 1),
        np.stack([la, ca, cb, hb, errors + 1, none], 1),
        # within one node the mirrored pair is the same pair
        np.stack([ca, ha, lb, cb, errors + 1, none], 1)[same == 0],
    ])
    return out[(out[:, 1] > out[:, 0]) & (out[:, 3] > out[:, 2]) & (out[:, 4] <= budget)]


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union of many pairs at once: larger roots hook to smaller ones until every pair shares its root."""
    while len(x):
        rx, ry = roots(parent, x), roots(parent, y)
        apart = rx != ry
        x, y = x[apart], y[apart]
        parent[np.maximum(rx, ry)[apart]] = np.minimum(rx, ry)[apart]


# --- groups -----------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (u, v); root is the smallest node reachable.

    Large-star and small-star in turn: each is one aggregation and one join on the edge list, which never grows, until the
    list is a star around the smallest node of each component. A star's centre may be hot: its edges are pre-aggregated, and
    the smallest neighbours are written, so that both sides of the join have a shuffle of their own and adaptive execution can
    split the centre's edges. What is written between the steps has as many partitions as the edges need, so a short list does
    not cost a task for each shuffle partition."""
    edges = stable(_clean(links))
    parts = parts_for(edges)
    edges = edges.coalesce(parts)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        outer = _star(both, parts).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stable(_clean(outer).coalesce(parts))
        small = _star(large, parts)
        hooks = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        own = F.struct("u", F.col("m").alias("v"))
        edges = stable(_clean(small.select(F.inline(F.array(hooks, own)))).coalesce(parts))
    pairs = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()


def parts_for(rows: DataFrame) -> int:
    """Partitions for narrow rows that are written already: one for each core, and more as the rows grow."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, parts: int) -> DataFrame:
    """Edges with m, the smallest of u and all its neighbours."""
    least = stable(edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).coalesce(parts))
    return edges.join(least, "u")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is no v, so that each v is the smallest node of its component (u > v)."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    open_ends = F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
    return degrees.agg(open_ends).first()[0] == 0


def grouped(docs: DataFrame, width: int, budget: int, doc_id: str, text: str, node_rows: int) -> DataFrame:
    """doc_id, digest, fp and the component's root fingerprint and smallest doc_id for every row."""
    marks = written(fingerprints(docs, width, doc_id, text), "fingerprints")
    nodes = stable(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = nodes.coalesce(parts_for(nodes))
    found = components(trie_links(nodes.select("fp"), budget, node_rows))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return marks.join(named, "fp")


def near_duplicates(
    docs: DataFrame, width: int = 3, budget: int = 2, doc_id: str = "doc_id", text: str = "text", node_rows: int = 8192,
) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of all documents reachable by links) for every row of ``docs``.

    A null doc_id is passed over when the smallest is taken; a component of null ids only has a null component_id."""
    return grouped(docs, width, budget, doc_id, text, node_rows).select("doc_id", "fp", "component_id")


def representatives(
    docs: DataFrame, width: int = 3, budget: int = 2, doc_id: str = "doc_id", text: str = "text", node_rows: int = 8192,
) -> DataFrame:
    """One row of ``docs``, all columns, for each component: the one with the smallest doc_id (null ids last), of several
    rows with that id the one with the smallest text digest, of rows equal in both any one."""
    return first_rows(docs, grouped(docs, width, budget, doc_id, text, node_rows), doc_id, text)


def first_rows(docs: DataFrame, named: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The chosen row of each ``root`` of ``named`` (doc_id, digest, root for every row of ``docs``)."""
    choice = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("ident"), "digest")
    chosen = named.groupBy("root").agg(F.min(choice).alias("c")).select("c.*")
    ident = quoted(doc_id).cast("long")
    rows = docs.select(
        packed(docs).alias("row"), ident.isNull().alias("none"), F.coalesce(ident, F.lit(0).cast("long")).alias("ident"),
        text_digest(text).alias("digest"))
    keys = ["none", "ident", "digest"]
    once = rows.join(chosen, keys).groupBy(*keys).agg(F.first("row").alias("row"))
    return unpacked(once, docs.columns, {})
