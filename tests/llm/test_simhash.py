from __future__ import annotations

import random

import numpy as np
import xxhash

from holdfast.llm import simhash
from tests.llm import edges


def brute_fingerprint(text: str, width: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, budget=2):
    """Smallest id reachable, by comparing everything with everything."""
    label = {f: f for f in set(fps)}
    root = lambda f: f if label[f] == f else root(label[f])
    known = sorted(label)
    for i, a in enumerate(known):
        for b in known[i + 1:]:
            if (a ^ b).bit_count() <= budget:
                label[root(b)] = root(a)
    least = {}
    for i, f in zip(ids, fps):
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in zip(ids, fps)}


def clustered(n, seed):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        f = rnd.choice(out[-40:])
        for _ in range(rnd.randint(1, 3)):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return sorted(set(out))


def test_fingerprint_by_definition():
    rnd = random.Random(1)
    for _ in range(60):
        words = [rnd.choice(["The", "a", "Ärger", "x.", "END", " y"]) for _ in range(rnd.randint(0, 30))]
        text = rnd.choice([" ", "\n", "\t\r "]).join(words)
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("") == 0


def test_long_texts_are_read_in_chunks_without_a_seam(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    assert len(text) < 1 << 20 < len(text) * 2
    one = simhash.fingerprint(text + " " + text)
    monkeypatch.setattr(simhash, "STEP", 1000)
    assert simhash.fingerprint(text + " " + text) == one


def test_walk_finds_every_link():
    fps = np.array(clustered(600, 2), np.uint64)
    u, v = simhash.walk(np.sort(fps), None, 0, 0, 2)
    found = brute_groups(list(range(len(fps))), fps.tolist())
    again = {f: f for f in fps.tolist()}
    root = lambda f: f if again[f] == f else root(again[f])
    for a, b in zip(u.tolist(), v.tolist()):
        again[root(a)] = root(b)
    groups = {}
    for i, f in enumerate(fps.tolist()):
        groups.setdefault(root(f), set()).add(found[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(found.values()))


def test_distributed_groups_equal_brute_force(spark):
    fps = clustered(500, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = brute_groups(list(range(len(fps))), fps)
    for node_rows in (8192, 16, 2):  # one task, some levels, full node pairs that are walked further down
        links = simhash.trie_links(nodes, 2, node_rows)
        root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        mine = {}
        for i, f in enumerate(signed):
            mine.setdefault(root.get(f, f), set()).add(expected[i])
        assert all(len(g) == 1 for g in mine.values()), node_rows
        assert len(mine) == len(set(expected.values())), node_rows


def test_long_chain_is_one_component(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    rows = simhash.components(links).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(n + 1)}
    assert simhash.components(links.limit(0)).collect() == []


def test_short_link_lists_take_few_tasks(spark, monkeypatch):
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    parts, stable = [], simhash.stable
    monkeypatch.setattr(simhash, "stable", lambda df: parts.append((out := stable(df)).rdd.getNumPartitions()) or out)
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
        assert {r["root"] for r in simhash.components(links).collect()} == {0}
        cores = spark.sparkContext.defaultParallelism
        assert len(parts) > 3 and max(parts[1:]) <= cores
        del parts[:]
        star = spark.createDataFrame([(5, k) for k in range(6, 30)], "u long, v long")
        assert {r["root"] for r in simhash.components(star).collect()} == {5}
        # nothing is left to do, so nothing further is written
        assert len(parts) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_query_by_brute_force(spark, sf_dir):
    from holdfast.llm.queries import op3_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in docs}
    groups = brute_groups(list(fps), list(fps.values()))
    out = op3_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in out} == {i: (f, groups[i]) for i, f in fps.items()}
    assert all(len(r["fingerprint"]) == 16 for r in out)


def test_edges(spark):
    docs = edges.documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(edges.ROWS)
    empty_group = {r["component_id"] for r in rows if r["fp"] == 0}
    assert empty_group == {2}  # null, empty and blank texts
    same = {r["component_id"] for r in rows if r["doc_id"] in (1, 5)}
    assert same == {1}
    assert simhash.near_duplicates(edges.empty(spark)).collect() == []


def test_one_row_of_each_group_stays(spark):
    docs = edges.documents(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == [1, 2, 4, 7, 8]
    only_null = docs.filter("doc_id IS NULL")
    assert simhash.representatives(only_null).count() == 2
    repeated = docs.filter("doc_id = 5")
    assert simhash.representatives(repeated).count() == 1
    assert simhash.representatives(edges.empty(spark)).collect() == []
