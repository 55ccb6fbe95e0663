import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from passbook.llm import mixing, sharding
from passbook.session import stage


def test_hypergeometric_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for total, marked, drawn in ((50, 20, 10), (10, 10, 5), (7, 0, 3), (0, 0, 0)):
        x = u.select(mixing.hypergeometric(F.col("u"), F.lit(total), F.lit(marked), F.lit(drawn)).alias("x"))
        mean, low, high = x.agg(F.avg("x"), F.min("x"), F.max("x")).first()
        assert abs(mean - drawn * marked / max(total, 1)) < 0.01
        assert low >= max(0, drawn - total + marked) and high <= min(drawn, marked)


def test_tree_shares_every_block(spark):
    blocks = spark.createDataFrame([(i + 1, 13 * i) for i in range(6)], "rank long, blocks long")
    for shards in (1, 5, 8):
        rows = {r["rank"]: r.ends for r in mixing.quotas(blocks, shards).collect()}
        assert all(e == sorted(e) and len(e) == shards and e[-1] == 13 * (k - 1) for k, e in rows.items())
        sizes = [sum(e[s] - (e[s - 1] if s else 0) for e in rows.values()) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 2


def test_targets_and_words(spark, edge, empty):
    rows = mixing.digest(mixing.mix(edge)).collect()
    assert len(rows) == edge.count()
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        key = r.source_size, r.target
        taken[key] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(t - k[1]) <= 1 and k[1] <= 3 * k[0] for k, t in taken.items())
    assert abs(sum(k[1] for k in taken) - sum(r.size for r in rows)) < 1e-6
    assert sorted(map(tuple, mixing.digest(mixing.mix(edge)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.digest(mixing.mix(empty)).count() == 0


def test_targets_of_many_words(spark):
    """The sums of words fit 32 bits, their products with a weight do not."""
    sized = spark.createDataFrame([(s, 500_000_000) for s in "abc"], "source string, size long")
    rows = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert rows == {"a": 250_000_000.0, "b": 500_000_000.0, "c": 750_000_000.0}


def test_mixed_documents_have_the_words_taken(spark, sf, edge, empty):
    held = stage(edge, "edge")
    want = sum(r.taken for r in mixing.digest(mixing.mix(held)).collect())
    out = mixing.mixed_documents(held)
    assert out.columns == edge.columns
    rows = out.collect()
    assert sum(len(r.text.encode().split()) for r in rows) == want
    assert mixing.mixed_documents(empty).count() == 0


def test_shards(spark, edge, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té "), "id").alias("text"))
    rows = sharding.assign(docs).collect()
    for r in rows:
        draws = [hashlib.md5(f"{r.doc_id}|{s}".encode()).hexdigest()[:13] for s in range(9)]
        assert r.shard == draws.index(max(draws[:8])) and r.grown_shard == draws.index(max(draws))
        assert r.text_crc32 == zlib.crc32(f"té {r.doc_id}".encode()) and r.size == len(f"té {r.doc_id}".encode()) + 1
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 500
    assert 200 < sum(r.grown_shard == 8 for r in rows) < 500
    assert len(sharding.assign(edge).collect()) == 12 and sharding.assign(empty).count() == 0


def test_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    shares = docs.groupBy(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0]).alias("s")).count().collect()
    assert abs({r.s: r["count"] for r in shares}[1] / 4000 - 0.75) < 0.04
