"""Report tables. All of them are long-form DataFrames; ``as_grid`` turns months into columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.category import category_detail
from passbook.functions.subcategory import category_label, group_of
from passbook.functions.text import party_key
from passbook.operators import metrics as M
from passbook.operators.ordered import with_running
from passbook.vocab import keywords as K

ORDER = ["txn_date", "file_idx", "row_seq"]


def accounting(paise: Column) -> Column:
    """1,234.50, with negatives in brackets."""
    s = F.format_number(F.abs(paise) / 100.0, 2)
    return F.when(paise < 0, F.concat(F.lit("("), s, F.lit(")"))).otherwise(s)


def day_text(c: str = "txn_date") -> Column:
    return F.date_format(c, "dd-MM-yyyy")


def month_label(c: str = "month") -> Column:
    return F.date_format(c, "MMM-yyyy")


def facility(layout: Column) -> Column:
    """Savings / Current / Overdraft as far as the layout id says."""
    low = F.lower(F.coalesce(layout, F.lit("")))
    drawn = F.array_contains(F.split(low, "_"), "od") | low.contains("overdraft") | low.contains("cash_credit")
    return (
        F.when(drawn, "Overdraft / Cash Credit").when(low.contains("saving"), "Savings")
        .when(low.contains("current"), "Current").otherwise("")
    )


def month_balances(days: DataFrame, anchors: list[int]) -> DataFrame:
    """Per month with rows: balance on each anchor day and the mean of all its days."""
    eod = M.eod_series(days).withColumn("month", M.month_of("day"))
    dom = F.dayofmonth("day")
    per = eod.groupBy("acct", "month").agg(
        *[F.max(F.when(dom == a, F.col("balance"))).alias(f"b{a}") for a in anchors],
        M.half_up(F.sum("balance"), F.count(F.lit(1))).alias("mean"),
    )
    active = days.select("acct", M.month_of().alias("month")).distinct()
    present = F.array_compact(F.array(*[F.col(f"b{a}") for a in anchors]))
    total = F.aggregate(present, F.lit(0).cast("bigint"), lambda a, x: a + x)
    anchor_mean = F.when(F.size(present) > 0, M.half_up(total, F.size(present)))
    return active.join(per, ["acct", "month"]).withColumn("anchor_mean", anchor_mean)


def _monthly(days: DataFrame) -> DataFrame:
    cols = ["n_in", "credits", "n_out", "debits", "inward", "issued", "outward", "deposited",
            "side_credits", "side_debits"]
    return days.groupBy("acct", M.month_of().alias("month")).agg(*[F.sum(c).alias(c) for c in cols])


def _rate(num: Column, den: Column) -> Column:
    return F.when(den != 0, F.round(10_000.0 * num / den) / 10_000.0).otherwise(0.0)


def summary_grid(days: DataFrame) -> DataFrame:
    """H1: fifteen metrics by month, and a Total/Avg cell per metric (null month)."""
    m = _monthly(days).join(month_balances(days, [5, 15, 25]), ["acct", "month"])
    c = F.col
    values = [
        c("b5"), c("b15"), c("b25"), c("anchor_mean"), c("mean"), c("n_in"), c("credits"), c("n_out"),
        c("debits"), c("inward"), c("issued"), _rate(c("inward"), c("issued")), c("outward"),
        c("deposited"), _rate(c("outward"), c("deposited")),
    ]
    cells = F.array(
        *[
            F.struct(F.lit(i + 1).alias("item_no"), F.lit(K.SUMMARY_ROWS[i]).alias("item"), v.cast("double").alias("value"))
            for i, v in enumerate(values)
        ]
    )
    long = m.select("acct", "month", F.explode(cells).alias("x")).select("acct", "month", "x.*")
    means = long.filter("item_no <= 5").groupBy("acct", "item_no", "item").agg(
        F.round(F.sum("value") / F.count("value")).alias("value")
    )
    sums = long.filter("item_no > 5 and item_no not in (12, 15)").groupBy("acct", "item_no", "item").agg(
        F.sum("value").alias("value")
    )
    whole = m.groupBy("acct").agg(*[F.sum(x).alias(x) for x in ("inward", "issued", "outward", "deposited")])
    rates = whole.select(
        "acct",
        F.explode(F.array(
            F.struct(F.lit(12).alias("item_no"), F.lit(K.SUMMARY_ROWS[11]).alias("item"), _rate(c("inward"), c("issued")).alias("value")),
            F.struct(F.lit(15).alias("item_no"), F.lit(K.SUMMARY_ROWS[14]).alias("item"), _rate(c("outward"), c("deposited")).alias("value")),
        )).alias("x"),
    ).select("acct", "x.*")
    totals = reduce(DataFrame.unionByName, [means, sums, rates])
    return long.unionByName(totals.withColumn("month", F.lit(None).cast("date")))


def as_grid(long: DataFrame, key: list[str], months: list, value: str = "value") -> DataFrame:
    """Months across, newest first. ``months`` is the report's own list of months."""
    labels = [m.strftime("%b-%Y") for m in sorted(months, reverse=True)]
    return long.withColumn("label", month_label()).groupBy(*key).pivot("label", labels).agg(F.first(value))


def eod_grid(days: DataFrame) -> DataFrame:
    """H2: day of month by month; a cell without a balance stays null."""
    months = days.select("acct", M.month_of().alias("month")).distinct()
    cells = months.withColumn("day_no", F.explode(F.sequence(F.lit(1), F.lit(31))))
    eod = M.eod_series(days).select(
        "acct", M.month_of("day").alias("month"), F.dayofmonth("day").alias("day_no"), "balance"
    )
    return cells.join(eod, ["acct", "month", "day_no"], "left")


def avg_balances(days: DataFrame) -> DataFrame:
    """H3: anchor-day balances and monthly flow."""
    m = _monthly(days).join(month_balances(days, [1, 10, 15, 25]), ["acct", "month"])
    return m.select(
        "acct", "month", "b1", "b10", "b15", "b25", "anchor_mean", F.col("credits").alias("inflow"),
        F.col("debits").alias("outflow"), (F.col("credits") - F.col("debits")).alias("net_flow"),
        F.col("inward").alias("inward_returns"), F.col("outward").alias("outward_returns"),
        F.col("side_credits").alias("no_of_credit"), F.col("side_debits").alias("no_of_debit"),
    )


def _directions(pm: DataFrame, group: list[str]) -> DataFrame:
    both = F.array(
        F.struct(F.lit("credit").alias("direction"), F.col("credits").alias("amount"), F.col("n_in").alias("n")),
        F.struct(F.lit("debit").alias("direction"), F.col("debits").alias("amount"), F.col("n_out").alias("n")),
    )
    sums = pm.groupBy("acct", "pkey", *group).agg(
        *[F.sum(c).alias(c) for c in ("credits", "debits", "n_in", "n_out")]
    )
    return sums.select("acct", "pkey", *group, F.explode(both).alias("x")).select(
        "acct", "pkey", *group, "x.*"
    ).filter("n > 0")


def top_parties_month(df: DataFrame) -> DataFrame:
    """H4: ten fixed slots per account, month and direction, filled or not."""
    sums = _directions(M.party_months(df), ["month"])
    keys = ["acct", "month", "direction"]
    w = Window.partitionBy(*keys).orderBy(F.desc("amount"), "pkey")
    top = sums.withColumn("slot", F.row_number().over(w)).filter("slot <= 10")
    top = top.join(M.party_labels(df), ["acct", "pkey"], "left")
    slots = top.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return slots.join(top, [*keys, "slot"], "left").select(
        *keys, "slot", F.col("label").alias("party"), "amount"
    )


def top_parties_period(df: DataFrame) -> DataFrame:
    """H5: ten largest parties over the whole period, by direction."""
    sums = _directions(M.party_months(df), [])
    w = Window.partitionBy("acct", "direction").orderBy(F.desc("amount"), "pkey")
    top = sums.withColumn("rk", F.row_number().over(w)).filter("rk <= 10")
    return top.join(M.party_labels(df), ["acct", "pkey"], "left").select(
        "acct", "direction", "rk", F.col("label").alias("party"), "amount"
    )


def destination(category: Column) -> Column:
    return F.coalesce(
        *[F.when(category == t, F.lit(n)) for t, n in K.DESTINATION_TABLES.items()], F.lit("Other Xns")
    )


def routed_rows(df: DataFrame) -> DataFrame:
    """H6, H7: every row to its table, to "Xns", and on Sundays to "SundayXns".

    The serial restarts per account and table; it is counted in day segments.
    """
    sunday = F.weekday("txn_date") == 6
    tables = F.array_compact(
        F.array(destination(F.col("category")), F.lit("Xns"), F.when(sunday, F.lit("SundayXns")))
    )
    out = df.withColumn("pkey", party_key("party")).withColumn("table_name", F.explode(tables))
    out = out.join(M.party_labels(df), ["acct", "pkey"], "left")
    group = F.coalesce("label", F.lit("unknown party"))
    shows = F.col("table_name").isin([*K.GROUPED_TABLES, "Xns"])
    out = out.withColumn("party_group", F.when(shows, group)).withColumn("category_label", category_label())
    return with_running(out, ["acct", "table_name"], "txn_date", ["file_idx", "row_seq"], index="sl_no")


def category_totals(df: DataFrame) -> DataFrame:
    """H8: count and net amount per tag, largest net first."""
    t = df.groupBy("acct", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("net"))
    w = Window.partitionBy("acct").orderBy(F.abs("net").desc(), "category")
    return t.withColumn("rk", F.row_number().over(w))


def category_mix(df: DataFrame) -> DataFrame:
    """H9: sub-category totals with their group; direction is the sign of the last row."""
    place = F.struct(*ORDER)
    t = df.filter(F.col("sub_category") != "").groupBy("acct", "sub_category").agg(
        F.max_by(F.when(F.col("amount") > 0, "credit").otherwise("debit"), place).alias("direction"),
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("amount"),
    )
    return t.withColumn("sub_group", group_of("sub_category"))


def largest_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The largest single credits and debits per account."""
    side = F.when(F.col("amount") > 0, "credit").otherwise("debit")
    w = Window.partitionBy("acct", "direction").orderBy(F.abs("amount").desc(), *ORDER)
    return df.withColumn("direction", side).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)


# Labels of the credit sheet: (metric, label, kind).
CREDIT_SHEET = [
    ("months", "Months covered", "int"),
    ("avg_monthly_credits", "Avg monthly credits (all inflows)", "money"),
    ("avg_monthly_turnover", "Avg monthly BUSINESS credits (turnover)", "money"),
    ("turnover", "Business credits (total)", "money"),
    ("turnover_share_pct", "Business credits as % of all credits", "pct"),
    ("avg_monthly_debits", "Avg monthly debits", "money"),
    ("credits", "Total credits", "money"),
    ("debits", "Total debits", "money"),
    ("avg_balance", "Average balance", "money"),
    ("min_balance", "Minimum balance", "money"),
    ("closing_balance", "Closing balance", "money"),
    ("cash_intensity_pct", "Cash intensity (% of turnover)", "pct"),
    ("emi_out_monthly", "EMI / interest outflow (monthly)", "money"),
    ("bounces", "Bounce / return events", "int"),
    ("penal", "Penal charges", "money"),
    ("disbursals", "Loan disbursals received", "money"),
    ("related_credit_pct", "Related-party share of credits", "pct"),
    ("distinct_credit_parties", "Distinct credit counterparties", "int"),
    ("top_party_share_pct", "Top counterparty share of credits", "pct"),
    ("turnover_trend", "Turnover trend", "text"),
    ("balance_stability_cv", "Balance stability (variation)", "num"),
    ("monthly_surplus", "Monthly surplus (net inflow)", "money"),
    ("servicing_coverage", "Debt-service coverage (turnover ÷ EMI)", "num"),
]


def credit_sheet(summary: DataFrame) -> DataFrame:
    """Label / value rows from the metrics row."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "money":
            return accounting(c)
        return F.concat(c.cast("string"), F.lit("%")) if kind == "pct" else c.cast("string")

    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("pos"), F.lit(label).alias("label"), shown(name, kind).alias("value"))
            for i, (name, label, kind) in enumerate(CREDIT_SHEET)
        ]
    )
    return summary.select("acct", F.explode(rows).alias("x")).select("acct", "x.*")


def csv_rows(df: DataFrame) -> DataFrame:
    """The twelve printed columns of the flat export."""
    numbered = with_running(df, ["acct"], "txn_date", ["file_idx", "row_seq"], index="sl_no")
    cheque = F.col("cheque_no") if "cheque_no" in df.columns else F.lit("")
    party = F.coalesce(F.expr("nullif(party, '')"), F.lit("unknown party"))
    return numbered.select(
        "sl_no", day_text().alias("date"), F.col("account_no").alias("account"), "bank",
        cheque.alias("cheque_no"), "description", accounting(F.col("amount")).alias("amount"),
        category_label().alias("category"), F.col("category").alias("tag"),
        category_detail().alias("category_detail"), party.alias("party"),
        F.format_number(F.col("balance") / 100.0, 2).alias("balance"),
    )
