"""Helpers that the corpus operators share.

Every operator selects the columns it reads first and names its own columns with a
leading underscore, so extra columns of the input never clash with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.session import stage

#: White space and words as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``_row``, a text that names each row the same way every time it is read.

    Of a Parquet table as it is read, that is a hash of the file's path and the place in the
    file, and nothing is copied. Any other table is written as stage ``name`` first, as its
    rows have no such name.
    """
    if "_row" in docs.columns:
        raise ValueError("columns that begin with an underscore are reserved: _row")
    place = F.concat_ws(".", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    steps = {line.split()[0] for line in str(docs._jdf.queryExecution().analyzed().toString()).splitlines() if line.strip()}
    if any(s.endswith("Relation") for s in steps) and len(steps) == 1:
        try:
            return docs.select("*", place.alias("_row"))
        except AnalysisException:  # not a table of files
            pass
    row = F.monotonically_increasing_id().cast("string")
    return stage(docs.withColumn("_row", row), name)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model may learn from: crc32 of the id's text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; they are set in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that only ``parts`` decide: 52 bits of their MD5."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column | str],
    totals: dict[str, Column],
    name: str,
    how: str = "sum",
) -> DataFrame:
    """Running totals (or maxima) within each group of ``by``, along ``order``.

    No group lands in one task: rows are dealt by range over (by, order), so a group of
    any size spreads over neighbouring partitions, each partition totals its part, and
    the totals of earlier parts (at most one row for each partition and group in it)
    are added. ``order`` should end in a column that breaks ties. ``df`` should be a
    stage table, as the range bounds are sampled from it first.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    parts = partitions(df.sparkSession)
    dealt = df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, name)
    part = dealt.groupBy(*by, "_part").agg(*(fold(c).alias(f"_t_{k}") for k, c in totals.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = part.select(
        *(F.col(c).alias(f"_by_{c}") for c in by),
        F.col("_part").alias("_of"),
        *(fold(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in totals),
    )
    match = F.col("_part") == F.col("_of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = dealt.join(before, match).withColumns(
        {k: fold(c).over(here) for k, c in totals.items()}
    )
    for k in totals:
        if how == "sum":
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"_b_{k}"), F.lit(0)))
        else:
            joined = joined.withColumn(k, F.greatest(F.col(k), F.col(f"_b_{k}")))
    return joined.drop("_part", "_of", *(f"_by_{c}" for c in by), *(f"_b_{k}" for k in totals))
