import datetime as dt

from passbook.session import local_session
from passbook.sources import tables


def test_no_balance_before_the_first_known_amount_of_a_day(tmp_path):
    spark = local_session("4", 4)
    day = lambda n: dt.date(2024, 1, n)
    rows = [  # order, part, account, line, quantity, price, status, date
        (1, 1, 1, 1, 1.0, 10.0, "O", day(20)), (2, 1, 1, 1, 1.0, None, "O", day(21)),
        (3, 1, 1, 1, 1.0, 5.0, "O", day(21)), (4, 1, 1, 1, 1.0, None, "O", day(21)),
        (5, 1, 2, 1, 1.0, None, "O", None), (6, 1, 2, 1, 1.0, 7.0, "O", None),
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate date"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "red blue")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = tables.ledger(spark, str(tmp_path)).where("slot < 12").orderBy("acct", "row_seq").collect()
    first = [r.balance for r in rows if r.acct == 1]
    assert first[1] is None and first[0] is not None and first[2] - first[0] == 500 and first[3] == first[2]
    undated = [r.balance for r in rows if r.acct == 2]
    # The standing payment without a date comes before both.
    assert undated[1] - undated[0] == 700
