"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str, oracle: str | None = None, text: tuple[str, ...] = ()
) -> Callable[[Query], Query]:
    """Register a query. ``text`` columns (dates, nullable flags) compare as strings."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in text})

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle and text:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle})"
        elif oracle:
            ORACLES[name] = oracle
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from passbook.plans import (  # noqa: F401
        q_batch, q_blocks, q_category, q_ledger, q_metrics, q_pages, q_party, q_reports, q_rows, q_streaming, q_validate,
    )
