"""Rows from an extractor that is not trusted with directions or page seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.operators.ordered import row_block, with_previous

FILE = ["acct", "file_idx"]
SEAM_TEXT = 40


def repaired_directions(rows: DataFrame) -> DataFrame:
    """Where the balance moved by just the row's amount, its sign decides the side.

    Steps are between printed balances, which no repair changes, so every row stands alone.
    Rows whose amount is not the step stay as they are. ``flipped`` marks changed rows.
    """
    linked = with_previous(rows.withColumn("__block", row_block()), FILE, "__block", ["row_seq"], {"__prev": "balance"})
    amount = F.coalesce(F.nullif("withdrawal", F.lit(0)), F.nullif("deposit", F.lit(0)))
    step = F.col("balance") - F.col("__prev")
    same = F.abs(F.abs(step) - F.abs(amount)) <= 1
    up = same & (step > 0) & (F.coalesce("deposit", F.lit(0)) == 0)
    down = same & (step < 0) & (F.coalesce("withdrawal", F.lit(0)) == 0)
    none = F.lit(None).cast("bigint")
    linked = linked.withColumn("__up", F.coalesce(up, F.lit(False))).withColumn("__down", F.coalesce(down, F.lit(False)))
    size = F.abs(amount)
    sides = {
        "withdrawal": F.when(F.col("__up"), none).when(F.col("__down"), size).otherwise(F.col("withdrawal")),
        "deposit": F.when(F.col("__down"), none).when(F.col("__up"), size).otherwise(F.col("deposit")),
    }
    return linked.select(
        *[sides[c].alias(c) if c in sides else c for c in rows.columns], (F.col("__up") | F.col("__down")).alias("flipped")
    )


def without_seams(rows: DataFrame) -> DataFrame:
    """Of rows that agree in date, amounts, balance and the text's beginning, the first."""
    w = Window.partitionBy(*FILE, "date", "withdrawal", "deposit", "balance", "__text").orderBy("row_seq")
    marked = rows.withColumn("__text", F.substring("description", 1, SEAM_TEXT))
    return marked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__text")
