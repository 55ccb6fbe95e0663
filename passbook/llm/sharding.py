"""Operator 9: sharding by weighted rendezvous hashing.

Each record key draws one number for every shard; the shard with the best weighted
score wins. A new shard adds one draw and leaves the others as they are, so records
only ever move into the new shard, in proportion to its weight.

Cases: a null key counts as the text ``null``; a null text has no bytes; rows that
repeat (same key) go to the same shard and get slots of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import running, text_of, unit
from passbook.session import stage

WEIGHTS = [1.0] * 8
LAW = "key"


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) that ``key`` belongs to under ``weights``."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct(
            (F.lit(-float(w)) / F.log(unit(name, F.lit(str(i))))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scores))["shard"]


def assign(
    docs: DataFrame,
    weights: list[float] = WEIGHTS,
    new_weight: float = 1.0,
    key: str = "doc_id",
) -> DataFrame:
    """Shard, slot in the shard, and the shard after one more of ``new_weight`` is added.

    The text is read once, for its size and checksum; only the small digest row is
    dealt. Slots follow the key order and are numbered by ``running``, so that a
    shard's rows never meet in one task.
    """
    text = text_of().cast("binary")
    digest = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, new_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["doc_id", "text_crc32", "size", "_row"]
    numbered = running(
        stage(digest, "shards"), ["shard"], order, {"slot": F.lit(1).cast("long")}, "slots"
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.col("slot") - 1).alias("slot"), "grown_shard",
    )


def sharded_documents(docs: DataFrame, weights: list[float] = WEIGHTS) -> DataFrame:
    """The documents with their shard in column ``shard`` (one of that name is replaced).

    No row moves: a writer may partition by the column, or a reader filter on it.
    """
    return docs.withColumn("shard", rendezvous(F.col("doc_id"), weights))
