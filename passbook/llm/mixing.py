"""Operator 8: mixing sources to target weights with a multivariate-hypergeometric tree.

1. Targets. Every source has a weight and gets its share of all words, up to
   ``MOST_PASSES`` times its own size; what is cut is shared again by weight among the
   rest. Only two sums per round come to the driver.
2. Stream. The documents of a source, ordered by a hash of their id, form a stream that
   is read from its start, again and again, until the target is met. The last document
   may give only its first words, so a source is at most one word off its target.
3. Blocks. The stream is cut into blocks of ``BLOCK_WORDS``; a document belongs to the
   block in which it starts. Of the blocks of all sources, a binary tree over the output
   shards draws exact quotas: each node gives its left half a hypergeometric number of
   the blocks of each source. The draws at the leaves add up to the quotas at the root.
4. Each shard takes the next blocks of each source's stream (disjoint, as the ranges
   are), and sorts its pieces by a hash of its own.

Cases: a null source is a source of its own, the last; a null or empty text has no
words, weighs nothing and is never taken; repeated rows are documents of their own; with
no words at all every target is 0; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import SPACE, WORD, let, partitions, running, text_of, unit, with_rows
from passbook.session import stage

WEIGHT_CYCLE = (1, 2, 3)
MOST_PASSES = 3
BLOCK_WORDS = 4096
SHARDS = 8


def _exact(col: Column) -> Column:
    return col.cast("decimal(38,0)")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: its rank, weight, size and target in words."""
    sums = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sources")
    ranked = running(
        sums, [], [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "mix_ranks"
    )
    # Long, as a weight is multiplied by sums of words.
    cycle = F.array(*(F.lit(w).cast("long") for w in WEIGHT_CYCLE))
    weighed = stage(
        ranked.withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(WEIGHT_CYCLE)).cast("int")))
        .withColumn("most", F.col("source_size") * MOST_PASSES),
        "mix_weights",
    )
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, left, share = total or 0, total or 0, weights or 1
    while True:
        over = _exact(F.col("most")) * F.lit(share) < _exact(F.col("weight")) * F.lit(left)
        full, free = weighed.agg(
            F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        now = (total - (full or 0), free or 1)
        if now == (left, share):
            break
        left, share = now
    even = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share))
    target = F.when(over, F.col("most").cast("double")).otherwise(even)
    return weighed.select("source", "rank", "weight", "source_size", target.alias("target"))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` blocks, out of ``total``, are among the ``marked`` ones.

    Inverse transform: weights relative to the mode follow from the ratio of neighbours,
    walking right and then left, until far beyond what a double can add.
    """

    def draw(v: Column) -> Column:
        n, k, d, mode = v["n"], v["k"], v["d"], v["mode"]

        def walk(right: bool, goal: Column, base: Column) -> Column:
            def step(acc: Column, j: Column) -> Column:
                x = mode + j if right else mode - j
                if right:
                    ratio = (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))
                else:
                    ratio = (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))
                p = F.when(j == 0, acc["p"]).otherwise(acc["p"] * ratio)
                counted = p if right else F.when(j == 0, 0.0).otherwise(p)
                upto = acc["sum"] + counted
                hit = acc["pick"].isNull() & (upto >= goal)
                return F.struct(
                    p.alias("p"), upto.alias("sum"), F.when(hit, x).otherwise(acc["pick"]).alias("pick")
                )

            first = F.struct(
                F.lit(1.0).alias("p"), base.alias("sum"), F.lit(None).cast("double").alias("pick")
            )
            steps = F.least(v["ups"] if right else v["downs"], v["spread"]).cast("int")
            return F.aggregate(F.sequence(F.lit(0), steps), first, step)

        never, none = F.lit(float("inf")), F.lit(0.0)
        whole = let(walk(True, never, none)["sum"], lambda half: walk(False, never, half)["sum"])
        return let(
            whole * v["u"],
            lambda goal: let(
                walk(True, goal, none),
                lambda up: F.coalesce(up["pick"], walk(False, goal, up["sum"])["pick"], mode),
            ),
        ).cast("long")

    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    sides = F.struct(
        u.alias("u"), n.alias("n"), k.alias("k"), d.alias("d"),
        F.greatest(F.lit(0.0), d + k - n).alias("low"), F.least(d, k).alias("high"),
        (F.sqrt(d * k / F.greatest(n, F.lit(1.0)) + 1) * 12 + 40).alias("spread"),
    )

    def centred(v: Column) -> Column:
        peak = F.floor((v["d"] + 1) * (v["k"] + 1) / (v["n"] + 2)).cast("double")
        mode = F.least(v["high"], F.greatest(v["low"], peak))
        names = ["u", "n", "k", "d", "low", "high", "spread"]
        return F.struct(*(v[c].alias(c) for c in names), mode.alias("mode"))

    def bounded(v: Column) -> Column:
        names = ["u", "n", "k", "d", "mode", "spread"]
        return F.struct(
            *(v[c].alias(c) for c in names), (v["high"] - v["mode"]).alias("ups"), (v["mode"] - v["low"]).alias("downs")
        )

    return let(sides, lambda a: let(centred(a), lambda b: let(bounded(b), draw)))


def quotas(blocks: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """``blocks`` (rank, blocks) to one row per source: ``ends``, the block range of each shard.

    The tree works on one array of sources per node (nodes: fewer than twice the shards),
    and no row of the corpus is in it.
    """
    kind = "array<struct<rank:bigint,q:bigint>>"
    node = blocks.agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("blocks").alias("q")))).cast(kind).alias("qs")
    ).select(F.lit(0).alias("lo"), F.lit(shards).alias("n"), "qs")

    def tally(col: str) -> Column:
        return F.aggregate(F.col(col), F.lit(0).cast("long"), lambda a, s: a + s["q"])

    depth = max(shards - 1, 0).bit_length()
    for _ in range(depth):
        half = F.floor(F.col("n") / 2).cast("int")
        start = F.struct(
            tally("qs").alias("rest"), F.floor(tally("qs") * half / F.col("n")).cast("long").alias("need"),
            F.expr(f"cast(array() as {kind})").alias("out"),
        )

        def draw(acc: Column, s: Column) -> Column:
            u = unit(F.lit(seed), F.col("lo").cast("string"), F.col("n").cast("string"), s["rank"].cast("string"))
            x = hypergeometric(u, acc["rest"], s["q"], acc["need"])
            return let(
                F.struct(s["rank"].alias("rank"), x.alias("q")),
                lambda e: F.struct(
                    (acc["rest"] - s["q"]).alias("rest"), (acc["need"] - e["q"]).alias("need"),
                    F.array_append(acc["out"], e).alias("out"),
                ),
            )

        def split(left: Column) -> Column:
            rest = F.zip_with(
                "qs", left, lambda a, b: F.struct(a["rank"].alias("rank"), (a["q"] - b["q"]).alias("q"))
            )
            return F.array(
                F.struct(F.col("lo").alias("lo"), half.alias("n"), left.alias("qs")),
                F.struct(
                    (F.col("lo") + half).alias("lo"), (F.col("n") - half).alias("n"), rest.cast(kind).alias("qs")
                ),
            )

        kids = F.when(F.col("n") > 1, let(F.aggregate("qs", start, draw)["out"], split)).otherwise(
            F.array(F.struct("lo", "n", "qs"))
        )
        node = stage(node.select(F.explode(kids).alias("k")).select("k.*"), "mix_tree")
    leaves = node.select(F.col("lo").alias("shard"), F.explode("qs").alias("s")).select("shard", "s.rank", "s.q")
    parts = leaves.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "q"))).alias("parts"))
    ends = F.transform(
        "parts",
        lambda p: F.aggregate(
            F.filter("parts", lambda o: o["shard"] <= p["shard"]), F.lit(0).cast("long"), lambda a, o: a + o["q"]
        ),
    )
    return parts.select("rank", ends.alias("ends"))


def mix(
    docs: DataFrame,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: str = "mix",
    row: Column | None = None,
) -> DataFrame:
    """One row per document: its size, its source's size and target, and its placements.

    ``placements`` has an entry for every pass that takes words of the document: the
    pass, the words taken from its start, the output shard, and the place in the shard
    (sort by it). At most ``MOST_PASSES`` entries.
    """
    row = row if row is not None else F.monotonically_increasing_id()
    sized = stage(
        docs.select(
            "doc_id", "source",
            F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_perm"),
            row.alias("_row"),
        ),
        "mix_sizes",
    )
    plan = targets(sized).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    plan = stage(plan.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")), "mix_plan")
    drawn = quotas(plan.select("rank", "blocks"), shards, seed)
    plan = plan.join(drawn, "rank").withColumnRenamed("source", "_source")
    stream = running(
        sized, ["source"], ["_perm", "doc_id", "_row"], {"upto": F.col("size")}, "mix_stream"
    )
    rows = stream.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "before", F.col("upto") - F.col("size")
    )

    def piece(p: Column) -> Column:
        start = p * F.col("source_size") + F.col("before")
        block = F.floor(start / block_words).cast("long")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("words") - start))
        shard = F.size(F.filter("ends", lambda e: e <= block))
        return F.struct(
            p.cast("int").alias("pass"), words.alias("words"), shard.alias("shard"),
            F.md5(F.concat_ws("|", F.col("_perm"), p.cast("string"), shard.cast("string"))).alias("place"),
        )

    passes = F.sequence(F.lit(0).cast("long"), F.lit(MOST_PASSES).cast("long"))
    placements = F.filter(F.transform(passes, piece), lambda s: s["words"] > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", placements.alias("placements"), "_row")


def digest(mixed: DataFrame) -> DataFrame:
    """``mix`` in the columns of the contract."""
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: a document row for each placement, in the order of the output shards.

    A document that gives only its first words is cut after them (and ``n_chars``, if
    there is one, is its new length). The rows are dealt by range over (shard, place).
    """
    held = with_rows(docs, "mix_input")
    pieces = mix(held, shards, row=F.col("_row")).select("_row", "size", F.explode("placements").alias("_p"))
    pieces = pieces.select("_row", F.col("size").alias("_size"), F.col("_p.words").alias("_words"),
                           F.col("_p.shard").alias("_shard"), F.col("_p.place").alias("_place"))
    rows = held.join(stage(pieces, "mix_pieces"), "_row")
    part = F.col("_words") < F.col("_size")
    words = F.regexp_extract_all("text", F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), "")
    rows = rows.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(part, length).otherwise(F.col("n_chars")))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "_shard", "_place", "_row")
    return dealt.sortWithinPartitions("_shard", "_place", "_row").select(*docs.columns)
