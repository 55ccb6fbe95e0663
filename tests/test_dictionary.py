import datetime as dt

from passbook.operators import categorise as ops


def test_a_dictionary_meets_written_rows(spark, monkeypatch):
    """Joined above the rules, a dictionary of one name took the driver's memory to plan."""
    plans, written = {}, ops.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().analyzed().toString()
        return written(df, name)

    monkeypatch.setattr(ops, "stage", noted)
    rows = [
        (1, 2024, n, dt.date(2024, 1, n), f"PAID {party} {n}", party, "other", side, amount)
        for n, (party, side, amount) in enumerate([("Hot Gear", "credit", 500), ("Hot Gear", "debit", -700), ("Cold Gear", "debit", -900)], 1)
    ]
    schema = "acct long, file_idx int, row_seq long, txn_date date, description string, party string, mode string, side string, amount long"
    known = spark.createDataFrame([("HOTGEAR", "Interest received", "Salary paid")], "party string, credit string, debit string")
    got = ops.tag_rows(spark.createDataFrame(rows, schema), dictionary=known).orderBy("row_seq")
    assert [(r.category, r.category_source) for r in got.select("category", "category_source").collect()] == [
        ("Interest received", "dictionary"), ("Salary paid", "dictionary"), ("Regular debit", "fallback"),
    ]
    assert "ECSRTN" in plans["ruled"] and "ECSRTN" not in plans["cascade"]
