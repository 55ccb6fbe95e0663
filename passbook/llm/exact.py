"""Operator 4: exact dedup by deterministic block naming.

A text is cut into blocks of ``BLOCK_CHARS``. Equal blocks are brought together by
sorting and get one integer name; pairs of neighbouring names get a name in turn, level
by level, until one name is left for each text. Two texts of the same number of levels
have the same last name exactly when all their blocks are equal, so, unlike with a
digest, different texts never meet.

A block that fills a third of the table would be one sort group. Blocks are therefore
named twice: first within (block, salt), with as many salts as shuffle partitions, and
then among the first bearers of each salt. Texts cross the network in these two sorts
only; all later joins are on integers.

Cases: a null text counts as empty, and all empty texts are equal; a null doc_id is the
smallest; of rows that repeat a doc_id with equal texts one is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm.common import ascii_lower, partitions, text_of
from passbook.session import stage

BLOCK_CHARS = 2048


def first_names(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its row, place in the text, the text's block count, and its name."""
    salts = partitions(docs.sparkSession)
    texts = docs.select(
        "doc_id",
        ascii_lower(text_of()).alias("_t"),
        F.monotonically_increasing_id().alias("_row"),
    ).select(
        "doc_id", "_row", F.sha2(F.col("_t").cast("binary"), 256).alias("_sha"),
        F.when(F.col("_t") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{block_chars}}}"), F.lit(0))).alias("_blocks"),
    )
    cut = texts.select(
        "doc_id", "_row", "_sha", F.size("_blocks").alias("n"), F.posexplode("_blocks").alias("at", "block")
    )
    # The bearer of a block is one struct, so that both readers of the first sort want
    # the same columns and share one exchange.
    bearer = F.struct(
        F.monotonically_increasing_id().alias("id"), F.col("_row").alias("row"), "at", "n", "doc_id",
        F.when(F.col("at") == 0, F.unhex("_sha")).alias("sha"),
    )
    dealt = cut.select("block", bearer.alias("b")).withColumn(
        "salt", F.pmod(F.xxhash64("b.id"), F.lit(salts)).cast("int")
    )
    within = dealt.withColumn("first", F.min("b").over(Window.partitionBy("block", "salt")))
    leaders = within.where(F.col("b.id") == F.col("first.id")).select("block", F.col("b.id").alias("leader"))
    named = leaders.select(
        "leader", F.min("leader").over(Window.partitionBy("block")).alias("name")
    )
    rows = within.select("b", F.col("first.id").alias("leader")).join(named, "leader")
    return rows.select("b.row", "b.doc_id", "b.sha", "b.n", "b.at", "name")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: (levels, name) is the identity of its text."""
    blocks = stage(first_names(docs, block_chars), "names_0")
    levels = F.ceil(F.log2("n")).cast("int")
    blocks = blocks.withColumn("levels", levels)
    heads = blocks.where("at = 0").select("row", "doc_id", "sha", "levels", "name")
    deepest = blocks.agg(F.max("levels")).first()[0] or 0
    done = [heads.where("levels = 0")]
    now = blocks.where("levels > 0").select("row", "at", "levels", "name")
    for level in range(1, deepest + 1):
        even = F.col("at") % 2 == 0
        pairs = (
            now.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at"), "levels")
            .agg(
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("r"),
            )
            .withColumn("id", F.monotonically_increasing_id())
        )
        pairs = stage(pairs, f"pairs_{level}")
        names = stage(pairs.groupBy("l", "r").agg(F.min("id").alias("name")), f"names_{level}")
        now = pairs.join(names, ["l", "r"]).select("row", "at", "levels", "name")
        ended = now.where((F.col("levels") == level)).select("row", "name")
        done.append(
            heads.where(F.col("levels") == level).drop("name").join(ended, "row")
            .select("row", "doc_id", "sha", "levels", "name")
        )
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return stage(every, "identities")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: the id that stays, its group's size, and whether it stays."""
    known = identities(docs, block_chars)
    groups = known.groupBy("levels", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    )
    groups = stage(groups, "exact_groups")
    return known.join(groups, ["levels", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
