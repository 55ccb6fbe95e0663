"""Row order inside one key without putting the whole key in one task.

A plain window over an account would sort every row of that account in a single
task, and one account may hold a third of all rows. Each helper below takes a
*segment* column that never decreases along the order (the day of a ledger row, a
block of row numbers in a statement). Rows are windowed inside ``key + segment``,
and only one summary row per segment is windowed over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1 << 16


MARK = "__mark"


def _with_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """``df`` with the summary row of each segment beside it, marked 0 where rows are 1.

    The rows are shuffled once this way, where a join would shuffle them for itself and
    again for the window; null keys fall together in a window as they are.
    """
    rows = df.withColumn(MARK, F.lit(1))
    return rows.unionByName(summary.withColumn(MARK, F.lit(0)), allowMissingColumns=True)


def row_block(col: str = "row_seq") -> Column:
    """Segment for statement order: blocks of consecutive row numbers."""
    return F.floor(F.col(col) / F.lit(ROWS_PER_BLOCK)).cast("bigint")


def with_running(
    df: DataFrame,
    key: list[str],
    seg: str,
    order: list[str],
    index: str | None = None,
    sums: dict[str, str] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add a 1-based row number (``index``) and inclusive running sums per key.

    ``maxima`` are running maxima inside the segment only.
    """
    sums, maxima = sums or {}, maxima or {}
    totals = df.groupBy(*key, seg).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(src).alias(f"__s_{out}") for out, src in sums.items()],
    )
    before = Window.partitionBy(*key).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        seg,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
        *[
            F.coalesce(F.sum(f"__s_{out}").over(before), F.lit(0)).alias(f"__s_{out}")
            for out in sums
        ],
    )
    inside = Window.partitionBy(*key, seg).orderBy(MARK, *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = []
    if index:
        # The summary row comes first and is no row of the segment.
        added.append((F.row_number().over(inside) - 1 + F.first("__n").over(upto)).cast("bigint").alias(index))
    for out, src in sums.items():
        added.append((F.sum(src).over(upto) + F.first(f"__s_{out}").over(upto)).alias(out))
    added += [F.max(value).over(upto).alias(out) for out, value in maxima.items()]
    keep = [c for c in df.columns if c != index and c not in sums]
    return _with_summary(df, offsets).select(*keep, *added, MARK).where(F.col(MARK) == 1).drop(MARK)


def with_previous(
    df: DataFrame, key: list[str], seg: str, order: list[str], cols: dict[str, str]
) -> DataFrame:
    """Add the previous row's values (``new name -> source column``) per key."""
    tails = df.groupBy(*key, seg).agg(
        F.max_by(
            F.struct(*[F.col(src).alias(out) for out, src in cols.items()]), F.struct(*order)
        ).alias("__tail")
    )
    tail = F.lag("__tail").over(Window.partitionBy(*key).orderBy(seg))
    prior = tails.select(*key, seg, tail.alias("__before"))
    inside = Window.partitionBy(*key, seg).orderBy(MARK, *order)
    # The first row of a segment follows the summary row, which holds the last values before it.
    first = F.lag(MARK).over(inside) == 0
    added = [
        F.when(first, F.lag(f"__before.{out}").over(inside)).otherwise(F.lag(src).over(inside)).alias(out)
        for out, src in cols.items()
    ]
    keep = [c for c in df.columns if c not in cols]
    return _with_summary(df, prior).select(*keep, *added, MARK).where(F.col(MARK) == 1).drop(MARK)
