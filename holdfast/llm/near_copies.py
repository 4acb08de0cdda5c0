"""Near copies by five-word similarity: SimHash finds candidates, shingle sets decide.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Words and shingles
are those of ``simhash``, so ASCII case and blanks do not count, and a shorter text is one shingle; texts without words and
null are copies of each other. Shingles are compared by their 64-bit hashes. Groups are the connected components.

Candidates: pairs whose SimHash fingerprints (three-word shingles) differ in at most ``BUDGET`` bits, every such pair. One
of four blocks of 16 bits then differs in two bits at most, so the trie self-join runs over four rotations of the
fingerprints: node pairs are walked together, their differing bits add up, and a pair is pruned when it has more than two in
the first 16 bits or more than ``BUDGET`` in all. What lies beyond the budget is not a candidate.

Check: a text with few candidates in a task gives pairs, each compared on its own. One with many gives only links that hold
its candidates together; such a group is dealt out as pairs of blocks, which return a spanning forest of their near copies. No step
returns all pairs of a dense group, but all of them are compared.

Null and empty texts have no words and are one group. Texts of any length are read whole, in steps; a text's shingle set must
fit into a task. Rows equal in id and text, and of all near copies the one with the smallest id (null last, then by text),
leave one row. An empty table gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import simhash
from holdfast.llm.common import prepare, quoted, written
from holdfast.llm.simhash import BITS, FRONTIER, _children, _leaves, components, roots, text_digest, trie_links, unite
from holdfast.operators.stable import stable

WIDTH = 5
BUDGET = 11
#: bits of a rotation's head and errors allowed there: BUDGET < (BITS / HEAD_BITS) * (HEAD_ERRORS + 1)
HEAD_BITS, HEAD_ERRORS = 16, 2
#: candidates of one text that a task returns as pairs
PAIRS = 32
#: fingerprints of a trie node that one task compares
NODE_ROWS = 32768
#: texts in a block of a dense group
BLOCK = 512
#: shingles of two blocks that are multiplied in one step
COLUMNS = 4096
#: leaf pairs that a node pair is not walked further for, and of one numpy step
LEAVES, STEP = 64, 1 << 20
#: digests of candidate texts are broadcast up to this many (8 bytes each)
BROADCAST_IDS = 1_000_000


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    parts = list(simhash.shingle_hashes(text, WIDTH))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def word_digest(text: str) -> str:
    """MD5 of the text's words."""
    digest = hashlib.md5()
    for chunk in simhash.word_chunks(text):
        digest.update("".join([w + " " for w in chunk]).encode())
    return digest.hexdigest()


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest (MD5 of the text), words (MD5 of its words) and fp for every row."""

    def score(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            fps = np.array([simhash.fingerprint(x) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([word_digest(x) for x in texts], pa.string()), pa.array(fps.view(np.int64))],
                ["doc_id", "digest", "words", "fp"])

    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"), quoted(text).cast("string").alias("text"))
    return source.mapInArrow(score, "doc_id long, digest string, words string, fp long")


# --- candidates -------------------------------------------------------------------------------------------------------


def near(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int, head: tuple[int, int]):
    """Index arrays (i, j) of all pairs of two sorted subtrees (``right`` None: within one, each pair once), both ``depth`` bits
    below the root and ``errors`` apart so far, that differ in at most ``budget`` bits and in at most head[1] of the first head[0].

    Node pairs are walked together; the differing bits add up, and a pair is pruned when they exceed the budget of its level."""
    other = left if right is None else right
    todo = [(depth, np.array([[0, len(left), 0, len(other), errors, right is None]], np.int64))] if len(left) and len(other) else []
    while todo:
        level, pairs = todo.pop()
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAVES
        if level == BITS:
            few[:] = True
        for part in np.array_split(pairs[few], max(1, int(few.sum()) * LEAVES // STEP)):
            i, j = _leaves(part)
            good = np.bitwise_count(left[i] ^ other[j]) <= budget
            i, j = i[good], j[good]
            # leaves below one node meet in both orders, and each with itself
            once = i < j if right is None else np.ones(len(i), bool)
            yield i[once], j[once]
        pairs = pairs[~few]
        if len(pairs):
            below = _children(left, other, pairs, level, head[1] if level < head[0] else budget)
            todo += [(level + 1, below[k:k + FRONTIER]) for k in range(0, len(below), FRONTIER)]


def candidates_of(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int, head: tuple[int, int]):
    """(u, v, dense): every near pair of fingerprints that have at most PAIRS candidates each, and links that hold the ends of all
    other near pairs together."""
    other = left if right is None else right
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    parent, pairs, degree = np.arange(len(both)), [np.zeros((2, 0), np.int64)], np.zeros(len(both), np.int64)
    for i, j in near(left, right, depth, errors, budget, head):
        j = j + shift
        # both ends count; a fingerprint that has too many takes part in links only
        degree += np.bincount(i, minlength=len(both)) + np.bincount(j, minlength=len(both))
        crowded = (degree[i] > PAIRS) | (degree[j] > PAIRS)
        unite(parent, i[crowded], j[crowded])
        pairs.append(np.stack([i[~crowded], j[~crowded]]))
    i, j = np.concatenate(pairs, axis=1)
    late = (degree[i] > PAIRS) | (degree[j] > PAIRS)
    unite(parent, i[late], j[late])
    i, j = i[~late], j[~late]
    root = roots(parent, np.arange(len(both)))
    linked = np.flatnonzero(root != np.arange(len(both)))
    dense = np.repeat([False, True], [len(i), len(linked)])
    return np.concatenate([both[i], both[linked]]), np.concatenate([both[j], both[root[linked]]]), dense


def candidate_links(nodes: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """u, v, dense over the distinct fingerprints of ``nodes`` (fp): all pairs within the budget, those of a crowd as links."""
    head = (HEAD_BITS, HEAD_ERRORS)
    assert budget < BITS // HEAD_BITS * (HEAD_ERRORS + 1)

    def joined(rows: DataFrame, depth: int, budget: int) -> DataFrame:
        def one_pair(key: tuple, group: pa.Table) -> pa.Table:
            side, fp = group.column("side").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
            a, b = key[0].as_py(), key[1].as_py()
            u, v, dense = candidates_of(left, None if a == b else right, depth, (a ^ b).bit_count(), budget, head)
            return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64)), "dense": pa.array(dense)})

        return rows.groupBy("a", "b").applyInArrow(one_pair, "u long, v long, dense boolean")

    def turned(name: str, by: int):
        c = F.col(name)
        return (F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by)) if by % BITS else c).alias(name)

    links = None
    for by in range(0, BITS, HEAD_BITS):
        found = trie_links(nodes.select(turned("fp", by)), budget, node_rows, head, joined)
        found = found.select(turned("u", BITS - by), turned("v", BITS - by), "dense")
        links = found if links is None else links.unionByName(found)
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "dense").distinct()


# --- check ------------------------------------------------------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of every left with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cells = [code[:len(row[0])], code[len(row[0]):]]
    # only what both sides hold counts
    shared = np.logical_and(*[np.bincount(c, minlength=len(values)) > 0 for c in cells])
    number = np.cumsum(shared) - 1
    for k in (0, 1):
        keep = shared[cells[k]]
        row[k], cells[k] = row[k][keep], number[cells[k][keep]]
        order = np.argsort(cells[k], kind="stable")
        row[k], cells[k] = row[k][order], cells[k][order]
    for low in range(0, int(shared.sum()), COLUMNS):
        part = []
        for k, n in ((0, len(left)), (1, len(right))):
            a, b = np.searchsorted(cells[k], [low, low + COLUMNS])
            matrix = np.zeros((n, COLUMNS), np.float32)
            matrix[row[k][a:b], cells[k][a:b] - low] = 1
            part.append(matrix)
        out += part[0] @ part[1].T
    return out


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of near copies inside each crowd; ``members``: root, words."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("words"), "blocks"))
    dealt = placed.select("root", "words", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    dealt = dealt.select("root", "words", "own", F.least("own", "to").alias("a"), F.greatest("own", "to").alias("b"))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        own, words = group.column("own").to_numpy(), group.column("words").to_pylist()
        found = [np.asarray(x, np.int64).view(np.uint64) for x in group.column("shingles").to_pylist()]
        first = np.flatnonzero(own == key[1].as_py())
        second = first if key[1].as_py() == key[2].as_py() else np.flatnonzero(own == key[2].as_py())
        parent = np.arange(len(words))
        if len(first) and len(second):
            size = np.array([len(x) for x in found])
            common = overlaps([found[i] for i in first], [found[i] for i in second]).astype(np.int64)
            x, y = np.nonzero(9 * common >= 4 * (size[first][:, None] + size[second][None, :]))
            unite(parent, first[x], second[y])
        root = roots(parent, np.arange(len(words)))
        linked = np.flatnonzero(root != np.arange(len(words)))
        return pa.table({"u": pa.array([words[i] for i in linked], pa.string()), "v": pa.array([words[i] for i in root[linked]], pa.string())})

    return dealt.join(sets.select("words", "shingles"), "words").groupBy("root", "a", "b").applyInArrow(compare, "u string, v string")


def pair_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v, each the words' digest) that are near copies."""
    size = sets.select("words", "n")
    for side in ("u", "v"):
        pairs = pairs.join(size.select(F.col("words").alias(side), F.col("n").alias(f"n_{side}")), side)
    pairs = pairs.filter(5 * F.least("n_u", "n_v") >= 4 * F.greatest("n_u", "n_v"))
    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("words").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    common = F.size(F.array_intersect("s_u", "s_v"))
    # common / (n_u + n_v - common) >= 4 / 5
    return pairs.filter(9 * common >= 4 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """words, n, shingles for the texts whose digests ``wanted`` (words, digest) has."""

    def make(batches):
        for batch in batches:
            found = [shingle_set(x or "").view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("words"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["words", "n", "shingles"])

    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    source = docs.select(text_digest(text).alias("digest"), quoted(text).cast("string").alias("text")).join(keys, "digest")
    # exact copies of a chosen text give the same set
    return source.select("words", "text").mapInArrow(make, "words string, n long, shingles array<long>").groupBy("words").agg(
        F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def links_of(docs: DataFrame, marks: DataFrame, text: str, budget: int, node_rows: int) -> DataFrame:
    """Links (u, v) of near copies, each a digest of words."""
    nodes = stable(marks.groupBy("fp", "words").agg(F.min("digest").alias("digest")))
    per_fp = nodes.groupBy("fp").agg(F.count("*").alias("k"))
    found = stable(candidate_links(nodes.select("fp").distinct(), budget, node_rows))
    # a fingerprint of many texts is a crowd by itself
    crowded = stable(per_fp.filter(F.col("k") > PAIRS).select("fp"))
    for side in ("u", "v"):
        found = found.join(crowded.select(F.col("fp").alias(side), F.lit(True).alias(f"c_{side}")), side, "left")
    found = found.select("u", "v", (F.col("dense") | F.coalesce("c_u", "c_v", F.lit(False))).alias("dense"))

    grouped = components(found.filter("dense").select("u", "v"))
    alone = crowded.join(grouped, crowded["fp"] == grouped["node"], "left_anti").select(F.col("fp").alias("node"), F.col("fp").alias("root"))
    crowd = grouped.unionByName(alone)
    members = stable(nodes.join(crowd, nodes["fp"] == crowd["node"]).select("root", "words").distinct())

    same = per_fp.filter(F.col("k").between(2, PAIRS)).select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    pairs = found.filter("not dense").select("u", "v").distinct().unionByName(same)
    for side, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(nodes.select(F.col("fp").alias(side), F.col("words").alias(name)), side)
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    pairs = stable(pairs.distinct())

    asked = members.select("words").unionByName(pairs.select(F.col("u").alias("words"))).unionByName(pairs.select(F.col("v").alias("words")))
    wanted = stable(nodes.select("words", "digest").join(asked.distinct(), "words"))
    sets = written(shingle_sets(docs, wanted, text), "shingle_sets")
    return pair_links(pairs, sets).unionByName(block_links(members, sets))


def representatives(
    docs: DataFrame, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS,
) -> DataFrame:
    """One row of ``docs``, all columns, for each group of near copies, chosen as ``simhash.representatives`` does."""
    prepare(docs.sparkSession)
    marks = written(fingerprints(docs, doc_id, text), "fingerprints")
    found = components(links_of(docs, marks, text, budget, node_rows))
    named = marks.join(found, marks["words"] == found["node"], "left").select("doc_id", "digest", F.coalesce("root", "words").alias("root"))
    return simhash.first_rows(docs, named, doc_id, text)
