import numpy as np
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from passbook.llm import vectors

ROWS = StructType([
    StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())),
    StructField("label", IntegerType()), StructField("node", StringType()), StructField("p", LongType()),
])


def slow(rows, threshold=0.95):
    unit = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], float)
        if not (len(x) and np.isfinite(x).all() and x.any()):
            unit.append(None)
            continue
        x = x / np.abs(x).max()
        unit.append(x / np.linalg.norm(x))
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= threshold
    links = [[j for j in range(len(rows)) if j != i and near(unit[i], unit[j])] for i in range(len(rows))]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, edge = {i}, [i]
        while edge:
            edge = [j for k in edge for j in links[k] if j not in seen and not seen.add(j)]
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), least, vec_id == least))
    return sorted(out, key=str)


def found(df, **how):
    rows = vectors.near_vectors(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()
    return sorted(map(tuple, rows), key=str)


def crowd(rng, n, d):
    """Vectors at random, chains of close ones, and a group of near copies."""
    x = [rng.normal(size=d) for _ in range(n)]
    for _ in range(n):
        base = x[int(rng.integers(len(x)))]
        x.append(base * rng.uniform(0.1, 9) + rng.normal(size=d) * rng.uniform(0, 0.5))
    hot = rng.normal(size=d)
    return x + [hot + rng.normal(size=d) * 0.05 for _ in range(n)]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(i * 7 % 1000, v.tolist()) for i, v in enumerate(crowd(rng, 60, 20))]
    rows += [(500 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [
        (2000, None), (2001, []), (2002, [0.0] * 20), (2003, [float("nan")] + [1.0] * 19), (2004, [float("inf")] * 20),
        (2005, [None] + [1.0] * 19), (None, rows[5][1]), (2006, rows[5][1]), (2006, rows[5][1]), (7, rows[9][1]),
        (2007, [1e200, 1e200, 0.0]), (2008, [1.0, 1.0, 0.0]), (2009, [1e-300, 1e-300, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], ROWS)
    want = slow(rows)
    assert sum(r[1] for r in want) > 2000 and len({r[2] for r in want}) > 60
    for tile_rows in (7, 64, None):
        assert found(df, tile_rows=tile_rows) == want


def test_the_threshold_itself_links(spark):
    root = (1 - 0.95**2) ** 0.5
    rows = [(1, [1.0, 0.0]), (2, [0.95, root * (1 - 1e-12)]), (3, [0.95 * (1 - 1e-9), -root])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], ROWS)
    assert found(df) == slow(rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_whole_table_and_floats(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert isinstance(df.schema["embedding"].dataType, ArrayType) and df.schema["embedding"].dataType.elementType == FloatType()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df) == slow(rows)


def test_dense_groups_give_no_pairs(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    rows = [(i, (hot + rng.normal(size=8) * 0.02).tolist(), 1, "x", 2) for i in range(1500)]
    rows += [(9000 + i, hot.tolist(), 1, "x", 2) for i in range(1500)]
    known, bearers, nodes = vectors.named_rows(spark.createDataFrame(rows, ROWS))
    assert known.count() == 3000 and nodes.count() == 1501
    assert vectors.tile_links(nodes, tile_rows=400).count() <= 1501 * 4
    got = vectors.near_vectors(spark.createDataFrame(rows, ROWS), tile_rows=400).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)}


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 12)), rng.normal(size=(60, 12))))
    cuts = [2, 4, 8, 12]
    rest = [[np.linalg.norm(x[:, c:], axis=1) for c in cuts] for x in (a, b)]
    for least in (-1.0, 0.0, 0.5, 0.9):
        i, j = vectors.near_pairs(a, b, *rest, cuts, least)
        assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(a @ b.T >= least), strict=True))


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    assert found(spark.createDataFrame([(5, None, 1, "x", 2), (None, None, 1, "x", 2)], ROWS)) == [(5, 0, 5, True), (None, 0, None, True)]
