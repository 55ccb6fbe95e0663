"""Operator 1: near-duplicate documents by SimHash and pigeonhole blocks.

Fingerprint: XXH64 (seed 42) of every 4-word shingle, repeats included; a bit is set if
it is set in more than half of the hashes. Fingerprints at ``RADIUS`` or fewer differing
bits are linked, and the links' components are the groups.

Blocks: with ``blocks`` blocks, close fingerprints agree on ``blocks - RADIUS`` of them at
least, so each choice of that many blocks is a join key. Any number of blocks finds every
link; more blocks mean longer keys and fewer chance partners. ``blocks_for`` picks the
first number whose keys have more values than there are fingerprints, so the partners of
a fingerprint by chance stay few at any size.

Hot groups: equal fingerprints are one node from the start. A key with more than ``CELL``
members is dealt into chunks, and each pair of chunks is a cell of its own; a cell gives
a star for each of its components, never all its pairs.

Cases: null, empty and blank texts have fingerprint zero and are linked as such; fewer
than four words make one shingle; a null doc_id counts in no minimum; repeated rows are
returned as often as they come; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from passbook.llm.common import text_of, with_rows
from passbook.llm.graph import components
from passbook.session import lookup_side, stage

WORDS = 4
SEED = 42
BITS = 64
RADIUS = 4
CELL = 1024
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: For similarity by sets of shingles: their words, the least similarity, and bands of least
#: hashes. Two texts at 0.8 share a band with a probability of 1 - (1 - 0.8 ** 6) ** 10 = 0.95,
#: at 0.85 of 0.99, at 0.4 of 0.04.
SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 10, 6
_ORDERS = np.random.default_rng(5).integers(1 << 62, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def word_runs(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of ``text`` in runs of bounded size, each led by the last ``overlap`` before it."""
    at, carry = 0, []
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carry + text[at:end].split()
        at = end
        yield words
        carry = words[-overlap:] if overlap else []


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    counts, total, seen = np.zeros(BITS, np.int64), 0, 0
    head: list[bytes] = []
    for words in word_runs(text.encode("utf-8", "surrogatepass").lower(), WORDS - 1):
        seen = max(seen, len(words))
        head = words if len(words) < WORDS else []
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
        hashes = np.fromiter(map(_hash, shingles), np.uint64)
        if len(hashes):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if not total:
        return _hash(b" ".join(head)) if head else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def masks(blocks: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bits of every choice of ``blocks - radius`` blocks, as signed numbers."""
    edges = [i * bits // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << bits) if bits == 64 and m >> 63 else m for m in chosen]


def blocks_for(nodes: int, radius: int = RADIUS, bits: int = BITS) -> int:
    """The fewest blocks whose keys have at least as many values as there are nodes."""
    blocks = radius + 3
    while blocks < 2 * radius + 3 and (blocks - radius) * bits // blocks < math.log2(max(nodes, 2)):
        blocks += 1
    return blocks


def stars(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each component of ``members`` within ``radius``: edges from its least to the others."""
    # Unsigned, as bits are counted of a number's absolute value.
    rest = np.unique(members.astype(np.int64)).view(np.uint64)
    edges = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        edge = np.array([root])
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for e in edge:
                near |= np.bitwise_count(rest ^ e) <= radius
            edge, rest = rest[near], rest[~near]
            edges += [(int(root.view(np.int64)), int(x)) for x in edge.view(np.int64)]
    return edges


def _cell_edges(radius: int):
    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def cell_edges(cells: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"a": a, "b": b} for a, b in stars(np.asarray(c), radius)] for c in cells], dtype=object
        )

    return cell_edges


def links(nodes: DataFrame, node: str, blocks: int | None = None, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) with the components of all pairs of ``nodes`` within ``radius``.

    ``nodes`` is a stage table of distinct fingerprints (bigint) in column ``node``.
    """
    blocks = blocks or blocks_for(nodes.count(), radius)
    keys = F.array(*(F.col(node).bitwiseAND(F.lit(m)) for m in masks(blocks, radius)))
    keyed = nodes.select(F.col(node).alias("fp"), F.posexplode(keys).alias("choice", "key"))
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(lookup_side(stage(shared, "fp_keys")), ["choice", "key"])
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    grid = met.select("choice", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cells = grid.groupBy(
        "choice", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    ).agg(F.collect_list("fp").alias("fps"))
    found = cells.select(F.explode(_cell_edges(radius)("fps")).alias("e"))
    return found.select("e.a", "e.b").distinct()


def groups(docs: DataFrame, row: Column | None = None, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, ``fp``, its group's least doc_id and ``root``; and ``_row``."""
    row = row if row is not None else F.monotonically_increasing_id()
    marked = docs.select("doc_id", fingerprints(text_of()).alias("fp"), row.alias("_row"))
    marked = stage(marked, "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp_nodes")
    joined = components(links(nodes, "fp", blocks))
    rooted = nodes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stage(rooted, "fp_roots")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fp_least")
    ids = stage(rooted.join(least, "root").select("fp", "root", "component_id"), "fp_ids")
    return marked.join(ids, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of the contract: doc_id, fingerprint, component_id."""
    return groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_hashes(text: str, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in arrays of bounded size; fewer words make one shingle."""
    head, some = [], False
    for run in word_runs(text.encode("utf-8", "surrogatepass").lower(), words - 1):
        head = run if len(run) < words else []
        shingles = map(b" ".join, zip(*(run[i:] for i in range(words)), strict=False))
        hashes = np.fromiter(map(_hash, shingles), np.uint64)
        for i in range(0, len(hashes), 4096):
            some = True
            yield hashes[i : i + 4096]
    if head and not some:
        yield np.array([_hash(b" ".join(head))], np.uint64)


def band_keys(text: str) -> np.ndarray:
    """``BANDS`` keys from the least hashes of a text's shingles, and two that name them all."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for hashes in shingle_hashes(text):
        np.minimum(least, (hashes[:, None] * _ORDERS[None, :]).min(axis=0), out=least)
    parts = [*least.reshape(BANDS, BAND_ROWS), least, least]
    keys = [xxhash.xxh64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(parts)]
    return np.array(keys, np.uint64).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def _banded(texts: pd.Series) -> pd.Series:
    return pd.Series([band_keys(t) for t in texts], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    """The distinct shingles of each text, by 32 bits of their hash."""
    none = [np.zeros(0, np.uint64)]
    sets = [np.unique(np.concatenate([*shingle_hashes(t), *none]) >> np.uint64(32)) for t in texts]
    return pd.Series([x.astype(np.uint32).view(np.int32) for x in sets], dtype=object)


def similar_links(held: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of ``rows`` (_row, rid, keys) between texts whose shingle sets are similar.

    Rows with the same least hashes are one node. Nodes that share a band are compared with
    the least node of it, never all with all: a group of copies shares all its bands. The
    check is of the whole sets; texts are read again for nodes that have a partner only.
    """
    names = [F.get("keys", BANDS).alias("k1"), F.get("keys", BANDS + 1).alias("k2")]
    named = rows.select("rid", "_row", "keys", *names)
    nodes = named.groupBy("k1", "k2").agg(F.min(F.struct("rid", "_row", "keys")).alias("of"))
    nodes = stage(nodes.select("k1", "k2", "of.*"), "near_nodes")
    copies = named.join(nodes.select("k1", "k2", F.col("rid").alias("lead")), ["k1", "k2"]).where("rid <> lead")
    banded = nodes.select("rid", F.posexplode(F.slice("keys", 1, BANDS)).alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rid").alias("lead")).where("n > 1")
    shared = lookup_side(stage(shared, "near_bands_shared"))
    pairs = banded.join(shared, ["band", "key"]).where("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    pairs = stage(pairs.distinct(), "near_pairs")
    some = lookup_side(stage(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "near_some"))
    some = stage(nodes.join(some, "rid", "left_semi").select("rid", "_row"), "near_partners")
    sets = stage(held.join(lookup_side(some), "_row").select("rid", _shingle_sets(text_of()).alias("set")), "near_sets")
    left, right = (sets.select(F.col("rid").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    close = both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9
    met = pairs.join(left, "a").join(right, "b").where(close)
    return met.select("a", "b").unionByName(copies.select(F.col("lead").alias("a"), F.col("rid").alias("b")))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: of each group the row with the least doc_id stays.

    Documents are in one group if their fingerprints are linked, or if their sets of
    ``SHINGLE``-word shingles are similar (Jaccard) by ``least`` or more. The fingerprint's
    bits alone do not find the latter, so shingles have bands of their own (see the README).
    Only fingerprints, bands and row names move; the texts are read again and the rows that
    go are taken out, by broadcast if they are few enough.
    """
    held = with_rows(docs, "near_input")
    found = stage(groups(held, F.col("_row")).select("root", "doc_id", "_row"), "near_found")
    bands = held.select("_row", _banded(text_of()).alias("keys"), F.monotonically_increasing_id().alias("rid"))
    bands = stage(bands, "near_bands")
    rows = stage(found.join(bands.select("_row", "rid"), "_row"), "near_rows")
    leads = rows.groupBy("root").agg(F.min("rid").alias("a"), F.count("*").alias("n")).where("n > 1").select("root", "a")
    prints = rows.join(stage(leads, "near_leads"), "root").select("a", F.col("rid").alias("b"))
    joined = components(prints.unionByName(similar_links(held, bands, least)))
    grouped = stage(rows.join(joined.withColumnRenamed("node", "rid").withColumnRenamed("root", "group"), "rid"), "near_grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    best = grouped.groupBy("group").agg(F.min(order)["_row"].alias("_best"))
    gone = grouped.join(stage(best, "near_best"), "group").where("_row <> _best").select("_row")
    return held.join(stage(gone, "near_gone"), "_row", "left_anti").drop("_row")
