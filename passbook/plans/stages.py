"""Stage tables of the ledger pipeline.

The tagged ledger costs three shuffles and the whole text cascade; every metric and
report reads it. It is written once per application to the shared stage folder and
scanned column-pruned afterwards.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from passbook.functions.modes import detect_mode
from passbook.functions.party import finish_party, with_party
from passbook.operators import parties, statements
from passbook.operators.categorise import categorise
from passbook.session import dense, stage
from passbook.sources import tables

_PATHS: dict[tuple[str, str, str], tuple[str, object]] = {}


def row_parties(df: DataFrame) -> DataFrame:
    """Mode and the row-level party path."""
    return finish_party(with_party(df.withColumn("mode", detect_mode("description"))))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger as a stage table, for plans that read it more than once."""
    return staged(spark, sf_dir, "ledger", lambda: tables.ledger(spark, sf_dir), rules=True)


def build_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger with mode, party, tag, confidence and sub-category (no stage table)."""
    rows = row_parties(ledger(spark, sf_dir))
    with dense(spark):
        named = stage(rows, "named")
    return categorise(named)


def staged(spark: SparkSession, sf_dir: str, name: str, build, rules: bool = False) -> DataFrame:
    """``build`` written once per application and input folder, then read back.

    ``rules`` is for tables that text rules read or make.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        df = build()
        with dense(spark) if rules else nullcontext():
            df = stage(df, name)
        _PATHS[key] = (df.inputFiles()[0].rsplit("/", 1)[0], df.schema)
    path, schema = _PATHS[key]
    return spark.read.schema(schema).parquet(path)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "tagged", lambda: build_tagged(spark, sf_dir), rules=True)


def statement_parties(rows: DataFrame) -> DataFrame:
    """The parties of each statement, by its own rows."""
    with dense(rows.sparkSession):
        read = stage(with_party(rows.withColumn("mode", detect_mode("description"))), "read_parties")
    return parties.resolve(read, statements.FILE)


def build_ledger(raw: DataFrame) -> DataFrame:
    """Printed rows of overlapping statements to one categorised ledger per account.

    Per statement: order, parties, orientation, content ids. Then the statements of an
    account are merged, repeats go, identifiers are resolved again over the whole account,
    and every row is tagged.
    """
    merged = stage(statements.merge(statements.normalise(raw, statement_parties)), "merged")
    known = stage(parties.resolve(merged, ["acct"], ("uid",), learn_names=False), "account_parties")
    return categorise(known)
