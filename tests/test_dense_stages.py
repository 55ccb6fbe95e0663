"""Stages around text rules: small files, one to a task; series and reversals leave the rows in place."""

import datetime as dt
from pathlib import Path

import pytest

from passbook import session
from passbook.operators import categorise as ops

ROWS = "acct long, file_idx int, row_seq long, txn_date date, description string, party string, mode string, side string, amount long, category string, category_source string"


@pytest.fixture
def no_guess(spark, monkeypatch):
    """Joins are broadcast only where the code asks for it, and only for a table of a few KB."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    monkeypatch.setattr(ops, "small_side", lambda df: session.small_side(df, 1 << 13))
    yield spark
    spark.conf.unset(key)


def ledger(spark):
    """An instalment, a mandate, and a failed machine withdrawal; the rest are payments of no series."""

    def row(n, day, party, mode, amount, text=None):
        side = "debit" if amount < 0 else "credit"
        return (1, 2024, n, day, text or f"PAID {party} {n}", party, mode, side, amount, "Regular debit", "fallback")

    months = [dt.date(2024, m, 5) for m in (1, 2, 3)]
    rows = [row(m, day, "MERIDIAN HOLDINGS", "imps", -3_123_700) for m, day in enumerate(months)]
    rows += [row(10 + m, day, "", "nach", -100_000) for m, day in enumerate(months)]
    rows += [row(20 + m, day, "", "other", -123_456) for m, day in enumerate(months)]
    rows += [row(30 + i, months[0], "", "atm-cash", a, "ATW-1") for i, a in enumerate((-500_000, 500_000))]
    rows += [row(40 + n, months[0], f"SHOP {n}", "upi", -60_000 - n) for n in range(3000)]
    return session.stage(spark.createDataFrame(rows, ROWS), "made")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_meet_their_rows_by_broadcast(no_guess):
    got = ops.with_recurrence(ledger(no_guess))
    assert "SortMergeJoin" not in plan(got)
    marked = got.where("rec_nach or rec_emi").select("row_seq", "rec_nach", "rec_emi").orderBy("row_seq").collect()
    assert [tuple(r) for r in marked] == [(n, False, True) for n in (0, 1, 2)] + [(n, True, False) for n in (10, 11, 12)]


def test_rows_that_bear_no_series_are_left_out(spark):
    written = ops.recurring_series(ledger(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "(amount" in written and "% 50000" in written.split("Filter")[-1]


def test_reversals_meet_their_rows_by_broadcast(no_guess):
    got = ops.flag_reversals(ledger(no_guess))
    assert "SortMergeJoin" not in plan(got)
    assert [r.row_seq for r in got.where("category_source = 'atm-reversal'").collect()] == [31]


def test_dense_stages_have_small_files_read_one_to_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "DENSE_ROWS", 10)
    kept = {key: spark.conf.get(key) for key in (session.ROWS_KEY, session.SPLIT_KEY)}

    def files(df):
        return len([f for f in df.inputFiles() if Path(f).name.startswith("part-")])

    with session.dense(spark):
        first = session.stage(spark.range(0, 100, 1, 1), "dense")
        second = session.stage(first.selectExpr("id + 1 as id"), "dense")
    assert files(first) == 10 and files(second) == 10
    assert {key: spark.conf.get(key) for key in kept} == kept
    assert second.selectExpr("sum(id)").first()[0] == 5050
