"""Operator 12: near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated into the axes of a principal component
analysis, so that the leading coordinates carry most of a product. Ordered by the first
one they are cut into tiles, and each pair of tiles is compared in blocks: the products of
the leading coordinates are worked out for the whole block, the rest is bounded by the
product of the lengths of the two remainders, and only pairs whose bound reaches the
threshold go on to the next coordinates. What is left after the last is checked with the
vectors as given. A rotation changes no product, so every link is found whatever sample the
axes were fitted on; the sample decides the speed only.

Two unit vectors whose first coordinates lie further apart than a chord of the threshold's
angle cannot link, so tiles that lie that far apart are not paired. Beyond that, the method
compares every tile with every other: work grows with the square of the number of different
vectors (see the README).

Copies: equal vectors are one node from the start, named within (vector, salt) and then
among the first bearers, so that a vector which fills a third of the table meets nowhere as
rows. A pair of tiles gives, per node, its number of linked rows and a star of its
component, never its pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length never link; copies of one vector link; a null vec_id
counts in no minimum; rows that repeat a vec_id are vectors of their own; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import partitions, running
from passbook.llm.graph import components
from passbook.session import stage

THRESHOLD = 0.95
#: Bytes of vectors that the axes are fitted on, at most, and vectors.
FIT_BYTES, FIT_ROWS = 32 << 20, 10_000
#: A table is cut into this many tiles, or into more of TILE_BYTES each.
TILES, TILE_BYTES = 10, 16 << 20
#: Vectors of a tile that are compared at a time, and coordinates of the first pass.
BLOCK, LEAD = 1024, 8
#: Bounds are taken this much wider than rounding can make a product.
SLACK = 1e-9


def unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors of length one in double precision, as rows, filled with zeros up to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        row = np.asarray(v, np.float64)
        row = row / np.abs(row).max()
        out[i, : len(row)] = row / np.sqrt(row @ row)
    return out


def axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, the direction of the largest spread first, from a bounded sample."""
    most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * width)))
    share = min(1.0, 1.2 * most / max(nodes.count(), 1))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = unit_rows(sample.select("embedding").limit(most).toPandas()["embedding"], width)
    return np.linalg.eigh(rows.T @ rows)[1][:, ::-1].copy()


def near_pairs(
    a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, cuts: list[int], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks whose product may reach the threshold.

    ``rest_a[k]`` are the lengths of what lies beyond the coordinate ``cuts[k]``. A pair is
    dropped at the first cut where even parallel remainders would not reach the threshold.
    """
    least = threshold - SLACK
    sums = a[:, : cuts[0]] @ b[:, : cuts[0]].T
    i, j = np.nonzero(sums + np.outer(rest_a[0], rest_b[0]) >= least)
    sums = sums[i, j]
    for k in range(1, len(cuts)):
        low, high = cuts[k - 1], cuts[k]
        if len(i) * 4 > len(a) * len(b):
            sums += (a[:, low:high] @ b[:, low:high].T)[i, j]
        else:
            # Gathered in bounded pieces.
            for s in range(0, len(i), 1 << 16):
                e = s + (1 << 16)
                sums[s:e] += np.einsum("ij,ij->i", a[i[s:e], low:high], b[j[s:e], low:high])
        on = sums + rest_a[k][i] * rest_b[k][j] >= least
        i, j, sums = i[on], j[on], sums[on]
    return i, j


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the pairs (i, j) in ``root``, which names each node's least."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def compare(tile: pd.DataFrame, turn: np.ndarray, threshold: float) -> pd.DataFrame:
    """(node, n, root) of a tile with itself (column ``side`` all 0) or of side 0 with side 1."""
    tile = tile.sort_values(["side", "node"], ignore_index=True)
    width = len(turn)
    unit = unit_rows(tile["embedding"], width)
    turned = unit @ turn
    sizes, copies = tile["d"].to_numpy(), tile["copies"].to_numpy()
    cuts = [min(width, LEAD)]
    while cuts[-1] < width:
        cuts.append(min(width, cuts[-1] * 2))
    rest = [np.sqrt(np.einsum("ij,ij->i", turned[:, c:], turned[:, c:])) for c in cuts]
    n, root = np.zeros(len(tile), np.int64), np.arange(len(tile))
    split = int((tile["side"] == 0).sum())
    within = split == len(tile)
    one_size = len(np.unique(sizes)) == 1
    for s in range(0, split, BLOCK):
        left = slice(s, min(s + BLOCK, split))
        for t in range(s if within else split, split if within else len(tile), BLOCK):
            right = slice(t, min(t + BLOCK, split if within else len(tile)))
            i, j = near_pairs(
                turned[left], turned[right], [r[left] for r in rest], [r[right] for r in rest], cuts, threshold
            )
            i, j = i + left.start, j + right.start
            keep = i < j
            if not one_size:
                keep &= sizes[i] == sizes[j]
            i, j = i[keep], j[keep]
            exact = np.empty(len(i))
            for p in range(0, len(i), 1 << 16):
                q = p + (1 << 16)
                exact[p:q] = np.einsum("ij,ij->i", unit[i[p:q]], unit[j[p:q]])
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            hook(root, i, j)
    nodes = tile["node"].to_numpy()
    linked = n > 0
    return pd.DataFrame({"node": nodes[linked], "n": n[linked], "root": nodes[root[linked]]})


def _comparing(turn: np.ndarray, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda tile: compare(tile, turn, threshold)


def _first_coordinate(turn: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    lead = turn[:, :1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p"] = (unit_rows(batch["embedding"], len(lead)) @ lead)[:, 0]
            yield batch

    return run


def named_rows(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, vec_id, leader), leader null where a vector links with nothing; leaders
    (leader, node); and nodes (node, d, embedding, copies, least), one for each vector."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("embedding").isNotNull() & ok & some, F.lit(False))
    rows = vectors.select(
        "vec_id", F.when(usable, F.col("embedding")).alias("embedding"), F.monotonically_increasing_id().alias("row")
    )
    rows = stage(rows, "vec_rows")
    salt = F.pmod(F.xxhash64("row"), F.lit(partitions(vectors.sparkSession))).alias("salt")
    # Two hashes name a vector; the vector itself goes with the first bearer only.
    name = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")]
    keyed = rows.where("embedding IS NOT NULL").select("row", "vec_id", *name, salt)
    salted = keyed.groupBy("h", "g", "salt").agg(
        F.min("row").alias("leader"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    salted = stage(salted, "vec_salted")
    firsts = stage(
        salted.groupBy("h", "g").agg(
            F.min("leader").alias("node"), F.sum("copies").alias("copies"), F.min("least").alias("least")
        ),
        "vec_firsts",
    )
    bearers = salted.join(firsts.select("h", "g", "node"), ["h", "g"]).select("leader", "node")
    of_row = keyed.select("row", "h", "g", "salt").join(salted.select("h", "g", "salt", "leader"), ["h", "g", "salt"])
    known = rows.select("row", "vec_id").join(of_row.select("row", "leader"), "row", "left")
    full = rows.select(F.col("row").alias("node"), F.size("embedding").alias("d"), "embedding")
    nodes = firsts.select("node", "copies", "least").join(full, "node")
    return known, bearers, stage(nodes, "vec_nodes")


def tile_links(nodes: DataFrame, threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """(node, n, root): links of each node by pair of tiles, and a star of its component there."""
    width, count = nodes.agg(F.max("d"), F.count("*")).first()
    if not count:
        return nodes.select("node", F.col("copies").alias("n"), F.col("node").alias("root")).limit(0)
    turn = axes(nodes, width)
    tile_rows = tile_rows or max(1, min(math.ceil(count / TILES), TILE_BYTES // (8 * width)))
    schema = nodes.select("node", "copies", "d", "embedding").schema.add("p", "double")
    placed = nodes.select("node", "copies", "d", "embedding").mapInPandas(_first_coordinate(turn), schema)
    placed = stage(placed, "vec_placed")
    order = running(placed.select("node", "d", "p").withColumn("_all", F.lit(0)), ["_all"], ["d", "p", "node"], {"at": F.lit(1)}, "vec_order")
    tiles = order.select("node", "d", "p", F.floor((F.col("at") - 1) / tile_rows).cast("long").alias("tile"))
    tiles = stage(tiles, "vec_tiles")
    # A tile reaches as far as a chord of the threshold's angle beyond its own ends. Both
    # are counted in steps of that chord, so tiles meet on equal steps.
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    ends = tiles.groupBy("tile", "d").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    steps = lambda low, high: F.sequence(F.floor(low / chord), F.floor(high / chord))
    ends = stage(ends, "vec_ends")
    own = ends.select("tile", "d", "lo", "hi", F.explode(steps(F.col("lo"), F.col("hi"))).alias("step"))
    reach = ends.select(
        F.col("tile").alias("with"), "d", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
        F.explode(steps(F.col("lo") - chord, F.col("hi") + chord)).alias("step"),
    )
    met = own.join(reach, ["d", "step"]).where(
        (F.col("tile") <= F.col("with")) & (F.col("lo2") <= F.col("hi") + chord) & (F.col("lo") <= F.col("hi2") + chord)
    )
    pairs = stage(met.select("tile", "with").distinct().withColumn("pair", F.monotonically_increasing_id()), "vec_pairs")
    sides = pairs.select(F.col("tile").alias("tile"), "pair", F.lit(0).alias("side")).unionByName(
        pairs.where("tile <> with").select(F.col("with").alias("tile"), "pair", F.lit(1).alias("side"))
    )
    dealt = placed.join(tiles.select("node", "tile"), "node").join(sides, "tile")
    return dealt.select("pair", "side", "node", "copies", "d", "embedding").groupBy("pair").applyInPandas(
        _comparing(turn, threshold), "node long, n long, root long"
    )


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    known, bearers, nodes = named_rows(vectors)
    found = stage(tile_links(nodes, threshold, tile_rows), "vec_links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = nodes.select("node", "copies", "least").join(links, "node", "left").join(joined, "node", "left")
    of_node = stage(
        of_node.select(
            "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "least",
            F.coalesce("root", "node").alias("root"),
        ),
        "vec_groups",
    )
    least = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = stage(of_node.join(least, "root").select("node", "n_links", "component_id"), "vec_out")
    of_leader = bearers.join(of_node, "node").select("leader", "n_links", "component_id")
    out = known.join(of_leader, "leader", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("leader").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
