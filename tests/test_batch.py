import datetime as dt
import random

from pyspark.sql import functions as F

from passbook.operators import batch as B
from passbook.sources import publish as P

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def slow_periods(ranges):
    out = []
    for lo, hi in sorted(ranges):
        if out and (lo - out[-1][1]).days <= 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def test_periods_of_a_hot_account(spark):
    rng, rows, want = random.Random(2), [], {}
    for acct in range(20):
        n = 3000 if acct == 0 else rng.randint(1, 40)
        span = 60_000 if acct == 0 else 900
        ranges = [(D(s := rng.randrange(span)), D(s + rng.choice([0, 3, 20, 90]))) for _ in range(n)]
        if acct == 1:
            ranges.append((D(0), D(2000)))
        want[acct] = slow_periods(ranges)
        rows += [(acct, lo, hi) for lo, hi in ranges]
    rows += [(3, None, D(1)), (3, D(1), None), (None, D(5), D(6)), (None, D(7), D(7)), (None, D(9), D(9))]
    got = {}
    for r in B.collapsed_periods(spark.createDataFrame(rows, "acct int, lo date, hi date")).orderBy("period").collect():
        got.setdefault(r.acct, []).append((r.period_from, r.period_to))
    assert got.pop(None) == [(D(5), D(7)), (D(9), D(9))]
    assert got == want and len(got[0]) > 100


def test_names(spark):
    df = spark.createDataFrame([("HDFC Bank", "50100000123"), ("  Own & Co. ", "12"), ("", "")], "b string, a string")
    rows = df.select(
        B.masked(F.col("a")), B.slug(F.col("b"), F.col("a")), B.title(F.lit("H"), F.col("b"), B.masked(F.col("a"))),
        B.title(F.lit(None).cast("string"), F.col("b"), F.lit("")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("XXXXXXX0123", "hdfc-bank-50100000123", "H - HDFC - XXXXXXX0123", "HDFC"), ("12", "own-co-12", "H - Own & Co. - 12", "Own & Co."),
        ("", "account", "H", ""),
    ]


def profile(spark, *rows):
    return spark.createDataFrame(
        list(rows), "layout string, rows long, not_reconciling long, party_named_pct double, mean_desc_len double, top_categories map<string,double>"
    )


def test_drift(spark):
    base = profile(spark, ("a", 10, 0, 50.0, 30.0, {"x": 50.0, "y": 3.0}), ("gone", 1, 0, 0.0, 0.0, {}), ("same", 5, 1, 9.0, 9.0, {"x": 10.0}))
    now = profile(spark, ("a", 11, 0, 51.0, 33.5, {"x": 47.0, "z": 3.5}), ("fresh", 1, 0, 0.0, 0.0, None), ("same", 5, 1, 9.9, 11.9, {"x": 13.0}))
    got = sorted((r.layout, r.metric, r.category, r.before, r.after) for r in B.drift(base, now).collect())
    assert sorted(got, key=str) == sorted([
        ("a", "rows", None, 10.0, 11.0), ("a", "mean_desc_len", None, 30.0, 33.5), ("a", "category", "z", 0.0, 3.5),
        ("gone", "missing", None, None, None), ("fresh", "new", None, None, None),
    ], key=str)


def test_costs_and_jobs(spark):
    usage = [(1, 10, 5, 1, 100), (1, None, None, None, None), (2, 10, 5, 1, None), (2, 1, 1, 1, 7), (3, None, None, None, None)]
    df = spark.createDataFrame(usage, "job_id long, tokens_in long, tokens_out long, calls long, micro_usd long")
    assert sorted(map(tuple, B.extraction_cost(df).collect())) == [(1, 1, 10, 5, 1, 100), (2, 2, 11, 6, 2, None), (3, 0, 0, 0, 0, None)]
    now = dt.datetime(2024, 1, 1, 12)
    jobs = [
        (1, "processing", now - dt.timedelta(minutes=21), None), (2, "processing", now - dt.timedelta(hours=9), now - dt.timedelta(minutes=20)),
        (3, "awaiting_upload", now - dt.timedelta(minutes=61), None), (4, "awaiting_upload", now - dt.timedelta(minutes=59), None),
        (5, "done", now - dt.timedelta(days=9), None),
    ]
    df = spark.createDataFrame(jobs, "job_id long, status string, created_at timestamp, updated_at timestamp")
    assert sorted(r.job_id for r in B.stale_jobs(df, F.lit(now)).collect()) == [1, 3]


def test_corrections(spark, tmp_path):
    def given(*rows):
        wide = [(j, *(dict(r).get(n) for n in P.WIDTHS), 5, place) for place, (j, r) in enumerate(rows)]
        return spark.createDataFrame(wide, "job_id long, " + ", ".join(f"{n} string" for n in P.WIDTHS) + ", amount long, place long")

    root, say = str(tmp_path / "c"), lambda **k: {"description": "d", **k}
    one = given((1, say(note=" n ")), (1, {"note": "n"}), (1, say(old_party="p")), (1, say(new_category="x" * 99)), (1, say(new_party="p")), (2, say(note="n")))
    got = [r.refused for r in P.append_corrections(one, root, 0, 2).orderBy("place").collect()]
    assert got == [None, "description required", "a corrected category, party or note is required", None, "correction limit reached", None]
    assert [r.refused for r in P.append_corrections(given((1, say(note="n")), (2, say(note="m"))), root, 1, 2).orderBy("place").collect()] == ["correction limit reached", None]
    P.append_corrections(one, root, 0, 2)
    held = spark.read.parquet(root)
    assert held.count() == 4 and {len(r.new_category) for r in held.collect()} == {0, 80} and held.where("note = 'n'").count() == 2
    out = str(tmp_path / "csv")
    P.export_corrections(held, out)
    assert [tuple(r) for r in P.read_truth(spark, out).collect()] == [("d", 5, "x" * 80, None)]


def test_reports_are_replaced_by_job(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = lambda *r: spark.createDataFrame(list(r), "table_name string, job_id int, n int")
    extra = lambda *r: spark.createDataFrame(list(r), "job_id int, v string")
    P.write_reports({"Extra": extra((1, "a"), (2, "b"))}, rows(("Xns", 1, 1), ("EMI Xns", 1, 2), ("Xns", 2, 3)), root)
    P.write_reports({"Extra": extra((1, "c"))}, rows(("Xns", 1, 9)), root)
    got = lambda name: sorted(map(tuple, P.read_report(spark, root, name).select("job_id", "n" if name != "Extra" else "v").collect()))
    assert got("Xns") == [(1, 9), (2, 3)] and got("EMI Xns") == [(1, 2)] and got("Extra") == [(1, "c"), (2, "b")]
    names = [r.name for r in spark.read.parquet(f"{root}/order").orderBy("pos").collect()]
    assert names[:19] == P.K.REPORT_TABLES and names[19:] == ["Extra", "Other Xns"]


def test_vocabulary(spark, tmp_path):
    base = P.load_keywords(spark)
    path = str(tmp_path / "words")
    spark.createDataFrame([("SWEEP_STAMPS", 0, "ONLY")], base.schema).write.json(path)
    got = P.load_keywords(spark, path)
    assert [r.keyword for r in got.where("list = 'SWEEP_STAMPS'").collect()] == ["ONLY"]
    assert got.where("list <> 'SWEEP_STAMPS'").count() == base.where("list <> 'SWEEP_STAMPS'").count()
    subs = P.subcategory_rows(spark).where("name = 'Rental Income'").orderBy("k").collect()
    assert [r.pattern for r in subs] == ["LICENCEFEE", "LICENSEFEE", "LEASE", "RENT"] and subs[0].side == "credit"
