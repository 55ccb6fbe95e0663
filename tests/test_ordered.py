import datetime as dt

import pytest

from passbook.operators.ordered import with_previous, with_running
from passbook.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session("4", 4)


def test_null_keys_and_segments_keep_their_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 1, 5), (1, day, 2, 7), (1, None, 3, 11), (None, day, 4, 13), (None, None, 5, 17)]
    df = spark.createDataFrame(rows, "acct int, txn_date date, row_seq int, amount int")
    got = with_running(df, ["acct"], "txn_date", ["row_seq"], index="n", sums={"run": "amount"}).collect()
    assert len(got) == 5 and sum(r.amount for r in got) == 53
    assert {(r.row_seq, r.n, r.run) for r in got if r.acct == 1} == {(3, 1, 11), (1, 2, 16), (2, 3, 23)}
    before = with_previous(df, ["acct"], "txn_date", ["row_seq"], {"prev": "amount"}).collect()
    assert len(before) == 5 and {r.row_seq: r.prev for r in before}[2] == 5


def test_rows_meet_their_summaries_without_a_join(spark):
    rows = [(1, 1, 1, None), (1, 1, 2, 7), (1, 2, 3, None), (None, 2, 4, 13)]
    df = spark.createDataFrame(rows, "acct int, seg int, row_seq int, amount int")
    run = with_running(df, ["acct"], "seg", ["row_seq"], index="n", sums={"run": "amount"})
    prev = with_previous(df, ["acct"], "seg", ["row_seq"], {"prev": "amount", "place": "row_seq"})
    assert {(r.row_seq, r.n, r.run) for r in run.collect()} == {(1, 1, None), (2, 2, 7), (3, 3, None), (4, 1, 13)}
    assert {(r.row_seq, r.prev, r.place) for r in prev.collect()} == {(1, None, None), (2, None, 1), (3, 7, 2), (4, None, None)}
    for out in (run, prev):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
