import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from passbook.llm import exact, simhash
from passbook.session import lookup_side, stage


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, near):
    """Component of each value, by comparing all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_groups_are_those_of_all_pairs(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text")
    docs = docs.unionByName(edge.select("doc_id", "text"))
    given = docs.collect()
    prints = [slow_fingerprint(r.text) for r in given]
    found = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, g in zip(given, found, strict=True):
        least[g] = min(x for x in (least.get(g), r.doc_id) if x is not None) if r.doc_id is not None else least.get(g)
    want = sorted((str(r.doc_id), f"{p:016x}", str(least[g])) for r, p, g in zip(given, prints, found, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == simhash._hash(b"a b c d")


def test_hot_keys_keep_their_components(spark):
    base = 0x0F0F_1234_5678_9ABC
    near = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}
    rng = np.random.default_rng(3)
    values = sorted(near) + [int(x) for x in rng.integers(0, 2**63, 300)]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    nodes = stage(spark.createDataFrame([(v,) for v in signed], "fp long"), "nodes")
    edges = simhash.links(nodes, "fp", blocks=7).collect()
    assert len(edges) < 200_000
    assert {v for e in edges for v in (e.a, e.b)} >= {v - 2**64 if v >> 63 else v for v in near}
    groups = simhash.components(spark.createDataFrame(edges)).groupBy("root").count().collect()
    assert [g["count"] for g in groups] == [len(near)]


def test_fingerprints_that_differ_in_the_sign_bit_are_linked(spark):
    far, near = (0x00FF << 40) + 6, (0x00FF << 40) + 7 - 2**63
    assert simhash.stars(np.array([far, near]), 4) == [(near, far)]
    assert simhash.stars(np.array([0, -1]), 4) == []
    nodes = stage(spark.createDataFrame([(far,), (near,)], "fp long"), "nodes")
    assert [(e.a, e.b) for e in simhash.links(nodes, "fp").collect()] == [(near, far)]


def test_any_number_of_blocks_finds_every_pair():
    for blocks in (5, 7, 8, 9):
        keys = [m % 2**64 for m in simhash.masks(blocks)]
        rng = np.random.default_rng(blocks)
        for _ in range(200):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            assert any(a & k == b & k for k in keys)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


def test_keep_one(spark, edge, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 5 not in ids
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_block_names_are_exact(spark, edge, empty):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abAB"), int(n))) for n in rng.integers(0, 9, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lower = [t.lower() for t in texts]
    keep, size = {}, {}
    for i, t in enumerate(lower):
        keep[t], size[t] = i, size.get(t, 0) + 1
    want = sorted((i, keep[t], size[t], keep[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(lower))
    assert sorted(map(tuple, exact.exact_groups(docs, block_chars=2).collect())) == want
    rows = exact.exact_groups(edge).collect()
    assert len(rows) == 12 and sum(r.kept for r in rows) == 9
    assert [r.keep_id for r in rows if r.doc_id in (3, 4)] == [4, 4]
    assert exact.exact_groups(empty).count() == 0


def test_near_copies_are_found_at_the_similarity(spark):
    """Pairs at 0.8 to 0.95 by five-word shingles: at least nine in ten; below 0.75 none."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], []
    for n in range(400):
        text = list(rng.choice(words, int(rng.integers(60, 400))))
        copy = list(text)
        changed = rng.choice(len(text), max(1, int(len(text) * rng.uniform(0.002, 0.06))), replace=False)
        for i in changed:
            copy[i] = "changed"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, copy))
        want.append(len(a & b) / len(a | b))
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * n in kept for n in range(400))
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)):
        some = [2 * n + 1 not in kept for n, j in enumerate(want) if low <= j < high]
        assert len(some) > 20 and np.mean(some) >= 0.9, (low, len(some), np.mean(some))
    assert np.mean([2 * n + 1 in kept for n, j in enumerate(want) if j < 0.8]) > 0.9


def test_groups_of_near_copies_stay_linear(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:150] + [f"x{i}"] + base[150:])) for i in range(1500)] + [(5000 + i, "same text " * 30) for i in range(1500)]
    held = simhash.with_rows(spark.createDataFrame(rows, "doc_id long, text string"), "x")
    bands = stage(held.select("_row", simhash._banded("text").alias("keys"), F.monotonically_increasing_id().alias("rid")), "bands")
    assert simhash.similar_links(held, bands).count() < 3000 * 13
    assert sorted(r.doc_id for r in simhash.keep_one(held.drop("_row")).collect()) == [0, 5000]


def test_exploded_keys_are_not_broadcast(spark):
    """The optimizer sizes keys after an explode as low as the nodes; the shared ones alone may be broadcast."""
    nodes = stage(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "many_nodes")
    plan = str(simhash.links(nodes, "fp")._jdf.queryExecution().executedPlan())
    assert "BuildLeft" not in plan
    few = stage(spark.range(10), "few_rows")
    for most, how in ((64 << 20, "BroadcastHashJoin"), (100, "SortMergeJoin")):
        met = spark.range(1000).join(lookup_side(few, most), "id")
        assert how in str(met._jdf.queryExecution().executedPlan()) and met.count() == 10
