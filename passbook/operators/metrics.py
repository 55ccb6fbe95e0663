"""Credit metrics per account.

Everything starts from two pre-aggregates that combine on the map side: one row per
account and day (``daily``) and one per account, party and month (``party_months``).
Both are bounded by the calendar, so the windows that follow stay small whatever the
size of an account. Money is BIGINT paise; averages are rounded half up to the paisa.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.category import high_risk_group
from passbook.functions.subcategory import credit_side
from passbook.functions.text import party_key
from passbook.vocab import keywords as K

POS = "pos"


def position() -> Column:
    """Row order inside a day as one BIGINT (file, then row)."""
    return (F.shiftleft(F.col("file_idx").cast("bigint"), 42) + F.col("row_seq")).alias(POS)


def _sum(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")


def daily(df: DataFrame) -> DataFrame:
    """One row per account and day: flows, tag sums and the closing balance."""
    amt, cat = F.col("amount"), F.col("category")
    size, inflow, outflow = F.abs(amt), amt > 0, amt < 0
    bounced = cat.isin(K.INWARD_BOUNCE, K.OUTWARD_BOUNCE)
    df = df.withColumn(POS, position()).withColumn("__cr", credit_side())
    return df.groupBy("acct", "txn_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(inflow).alias("n_in"),
        F.count_if(outflow).alias("n_out"),
        _sum(inflow, amt).alias("credits"),
        _sum(outflow, -amt).alias("debits"),
        _sum(inflow & ~cat.isin(K.NON_TURNOVER), amt).alias("turnover"),
        _sum(cat == K.CASH_IN, size).alias("cash_in"),
        _sum(cat.isin(K.EMI, K.INTEREST_OUT), size).alias("emi_out"),
        F.count_if(bounced).alias("bounces"),
        _sum(bounced | (cat == K.PENAL), size).alias("penal"),
        _sum(cat == K.DISBURSAL, size).alias("disbursals"),
        _sum(cat == K.RELATED_IN, size).alias("related_in"),
        F.count_if(cat == K.INWARD_BOUNCE).alias("inward"),
        F.count_if(cat == K.OUTWARD_BOUNCE).alias("outward"),
        F.count_if(cat.isin(K.PAYMENTS_ISSUED)).alias("issued"),
        F.count_if(cat.isin(K.PAYMENTS_DEPOSITED)).alias("deposited"),
        F.count_if("__cr").alias("side_credits"),
        F.count_if(~F.col("__cr")).alias("side_debits"),
        F.max_by("balance", POS).alias("closing"),
    )


def month_of(c: str = "txn_date") -> Column:
    return F.trunc(c, "month")


def half_up(num: Column, den: Column) -> Column:
    """num / den rounded half away from zero to a whole number."""
    return F.round(num.cast("double") / den.cast("double")).cast("bigint")


def pct(num: Column, den: Column) -> Column:
    """100 * num / den to one decimal; 0 when there is nothing to divide by."""
    return F.when(den != 0, F.round(1000.0 * num / den) / 10.0).otherwise(0.0)


def account_totals(days: DataFrame) -> DataFrame:
    """Flows, per-month averages, tag sums and ratios."""
    flows = ["credits", "debits", "turnover", "cash_in", "emi_out", "bounces", "penal",
             "disbursals", "related_in"]
    t = days.groupBy("acct").agg(
        F.count_distinct(month_of()).alias("months"), *[F.sum(c).alias(c) for c in flows]
    )
    m = F.col("months")
    return t.select(
        "acct", "months", *flows,
        (F.col("credits") - F.col("debits")).alias("net_cashflow"),
        half_up(F.col("credits"), m).alias("avg_monthly_credits"),
        half_up(F.col("debits"), m).alias("avg_monthly_debits"),
        half_up(F.col("turnover"), m).alias("avg_monthly_turnover"),
        half_up(F.col("emi_out"), m).alias("emi_out_monthly"),
        half_up(F.col("credits") - F.col("debits"), m).alias("monthly_surplus"),
        pct(F.col("turnover"), F.col("credits")).alias("turnover_share_pct"),
        pct(F.col("cash_in"), F.col("turnover")).alias("cash_intensity_pct"),
        pct(F.col("related_in"), F.col("credits")).alias("related_credit_pct"),
        F.when(F.col("emi_out") != 0, F.round(100.0 * F.col("turnover") / F.col("emi_out")) / 100.0)
        .alias("servicing_coverage"),
    )


def balance_runs(days: DataFrame) -> DataFrame:
    """Each closing balance with the number of days it stood (carried forward)."""
    w = Window.partitionBy("acct").orderBy("txn_date")
    until = F.coalesce(F.lead("txn_date").over(w), F.date_add("txn_date", 1))
    return days.select(
        "acct", "txn_date", "closing", F.datediff(until, "txn_date").cast("bigint").alias("days")
    )


def eod_series(days: DataFrame) -> DataFrame:
    """One row per calendar day, first to last."""
    runs = balance_runs(days)
    last = F.date_add("txn_date", (F.col("days") - 1).cast("int"))
    return runs.select(
        "acct", F.explode(F.sequence("txn_date", last)).alias("day"), F.col("closing").alias("balance")
    )


def balance_stats(days: DataFrame) -> DataFrame:
    """Mean, minimum, closing and the low-balance floor.

    Works on standing balances weighted by their days, so nothing is exploded.
    """
    runs = balance_runs(days)
    acc = runs.groupBy("acct").agg(
        F.sum("days").alias("eod_days"),
        half_up(F.sum(F.col("closing") * F.col("days")), F.sum("days")).alias("avg_balance"),
        F.min("closing").alias("min_balance"),
        F.max_by("closing", "txn_date").alias("closing_balance"),
    )
    floor = F.greatest(F.lit(1_000_000).cast("bigint"), F.round(F.col("avg_balance") / 10.0).cast("bigint"))
    acc = acc.withColumn("low_threshold", F.when(F.col("avg_balance") > 0, floor))
    low = runs.join(acc.select("acct", "low_threshold"), "acct").withColumn(
        "low", F.col("closing") < F.col("low_threshold")
    )
    w = Window.partitionBy("acct").orderBy("txn_date")
    islands = low.withColumn("island", F.sum(F.when(F.col("low"), 0).otherwise(1)).over(w))
    streaks = (
        islands.filter("low").groupBy("acct", "island").agg(F.sum("days").alias("streak"))
        .groupBy("acct").agg(F.sum("streak").alias("low_days"), F.max("streak").alias("longest_low_streak"))
    )
    known = F.col("low_threshold").isNotNull()
    zero = F.lit(0).cast("bigint")
    return acc.join(streaks, "acct", "left").select(
        "acct", "eod_days", "avg_balance", "min_balance", "closing_balance", "low_threshold",
        F.when(known, pct(F.coalesce("low_days", zero), F.col("eod_days"))).alias("low_days_pct"),
        F.coalesce("longest_low_streak", zero).alias("longest_low_streak"),
    )


def monthly_flow(days: DataFrame) -> DataFrame:
    """Credits, turnover, debits and net of every month with either."""
    m = days.groupBy("acct", month_of().alias("month")).agg(
        F.sum("credits").alias("credits"), F.sum("turnover").alias("turnover"),
        F.sum("debits").alias("debits"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"),
    )
    return m.filter((F.col("n_in") > 0) | (F.col("n_out") > 0)).select(
        "acct", "month", "credits", "turnover", "debits",
        (F.col("credits") - F.col("debits")).alias("net"),
    )


def turnover_trend(months: DataFrame) -> DataFrame:
    """First half against the rest, last three months against the prior."""
    by_month = Window.partitionBy("acct").orderBy("month")
    acct = Window.partitionBy("acct")
    earned = F.col("turnover") > 0
    ranked = months.select(
        "acct", "turnover",
        F.count_if(earned).over(by_month).alias("rank"),
        F.count_if(earned).over(acct).alias("n"),
        F.row_number().over(by_month).alias("pos"),
        F.count(F.lit(1)).over(acct).alias("total"),
    )
    early = earned & (F.col("rank") <= F.floor(F.col("n") / 2))
    recent = F.col("pos") > F.col("total") - 3
    t = ranked.groupBy("acct").agg(
        F.max("n").alias("n"), F.max("total").alias("total"),
        _sum(early, F.col("turnover")).alias("first"),
        _sum(earned & ~early, F.col("turnover")).alias("second"),
        _sum(recent, F.col("turnover")).alias("last3"),
        _sum(~recent, F.col("turnover")).alias("prior"),
    )
    change = (F.col("second") - F.col("first")) / F.col("first")
    judged = (F.col("n") >= 4) & (F.col("first") > 0)
    prior_avg = F.col("prior") / (F.col("total") - 3)
    return t.select(
        "acct",
        F.when(~judged, "flat").when(change > 0.15, "rising").when(change < -0.15, "declining")
        .otherwise("stable").alias("turnover_trend"),
        F.when(
            (F.col("total") >= 6) & (F.col("prior") > 0),
            F.round(1000.0 * (F.col("last3") / 3.0 - prior_avg) / prior_avg) / 10.0,
        ).alias("last_quarter_change_pct"),
        half_up(F.col("last3"), F.lit(3)).alias("last3_avg"),
        F.when(F.col("total") > 3, half_up(F.col("prior"), F.col("total") - 3)).alias("prior_avg"),
    )


def balance_stability(days: DataFrame) -> DataFrame:
    """Spread of the monthly mean of days with rows, over its mean."""
    monthly = days.groupBy("acct", month_of().alias("month")).agg(
        (F.sum("closing") / F.count(F.lit(1))).alias("mean")
    )
    t = monthly.groupBy("acct").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std")
    )
    stats = balance_stats(days).select("acct", "avg_balance")
    ok = (F.col("n") >= 2) & (F.col("avg_balance") > 0) & (F.col("mean") > 0)
    return t.join(stats, "acct").select(
        "acct", F.when(ok, F.round(F.col("std") / F.col("mean"), 2)).alias("balance_stability_cv")
    )


# ------------------------------------------------------------------- parties


def party_labels(df: DataFrame) -> DataFrame:
    """The fullest spelling seen per account and party key; earliest wins a tie."""
    named = df.filter(F.col("party") != "")
    seen = F.struct((-F.length("party")).alias("l"), "txn_date", "file_idx", "row_seq")
    return named.groupBy("acct", party_key("party").alias("pkey")).agg(
        F.trim(F.min_by("party", seen)).alias("label")
    )


def party_months(df: DataFrame) -> DataFrame:
    """One row per account, party key and month."""
    amt = F.col("amount")
    return (
        df.filter(F.col("party") != "")
        .groupBy("acct", party_key("party").alias("pkey"), month_of().alias("month"))
        .agg(
            _sum(amt > 0, amt).alias("credits"), _sum(amt < 0, -amt).alias("debits"),
            F.count_if(amt > 0).alias("n_in"), F.count_if(amt < 0).alias("n_out"),
        )
    )


def concentration(df: DataFrame) -> DataFrame:
    """Top credit parties and their share of all credits."""
    sums = (
        party_months(df).groupBy("acct", "pkey")
        .agg(F.sum("credits").alias("credits"), F.sum("n_in").alias("n_in")).filter("n_in > 0")
    )
    rank = Window.partitionBy("acct").orderBy(F.desc("credits"), "pkey")
    top = sums.withColumn("rk", F.row_number().over(rank)).filter("rk <= 3")
    top = top.join(party_labels(df), ["acct", "pkey"], "left")
    count = sums.groupBy("acct").agg(F.count(F.lit(1)).alias("distinct_credit_parties"))
    total = df.groupBy("acct").agg(_sum(F.col("amount") > 0, F.col("amount")).alias("total"))
    shares = top.groupBy("acct").agg(
        F.max("credits").alias("top1"), F.sum("credits").alias("top3"),
        F.array_sort(F.collect_list(F.struct("rk", F.col("label").alias("party"), "credits"))).alias("top_list"),
    )
    zero = F.lit(0).cast("bigint")
    return total.join(count, "acct", "left").join(shares, "acct", "left").select(
        "acct", F.coalesce("distinct_credit_parties", zero).alias("distinct_credit_parties"),
        pct(F.coalesce("top1", zero), F.col("total")).alias("top_party_share_pct"),
        pct(F.coalesce("top3", zero), F.col("total")).alias("top3_party_share_pct"),
        F.array_join(F.transform("top_list", lambda x: F.concat_ws(":", x["party"], x["credits"].cast("string"))), "; ")
        .alias("top_credit_parties"),
    )


def _period(df: DataFrame) -> DataFrame:
    return df.groupBy("acct").agg(
        F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end")
    )


def emi_obligations(df: DataFrame, top: int | None = 15) -> DataFrame:
    """Instalment obligations, largest first; ``top`` of an account, or all if it is None."""
    key = party_key("party")
    nearest = (F.bround(-F.col("amount") / 10_000.0).cast("bigint") * 100).cast("string")
    emi = df.filter((F.col("category") == K.EMI) & (F.col("amount") < 0))
    monthly = emi.groupBy(
        "acct", F.when(key == "", F.concat(F.lit("AMT"), nearest)).otherwise(key).alias("pkey"),
        month_of().alias("month"),
    ).agg(
        (-F.sum("amount")).alias("paid"), F.min("txn_date").alias("first_seen"), F.max("txn_date").alias("last_seen")
    )
    o = monthly.groupBy("acct", "pkey").agg(
        F.round(F.median("paid")).cast("bigint").alias("monthly_amount"),
        F.count(F.lit(1)).alias("months_seen"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("paid").alias("total_paid"),
    )
    o = o.join(party_labels(df), ["acct", "pkey"], "left").join(_period(df), "acct")
    o = o.withColumn("party", F.coalesce("label", F.lit("(unnamed)")))
    w = Window.partitionBy("acct").orderBy(F.desc("monthly_amount"), "party")
    active = F.col("last_seen") >= F.date_sub("period_end", 45)
    cut = F.date_sub("period_end", 90)
    fresh = active & (F.col("first_seen") >= cut) & (F.col("period_start") < cut)
    o = o.withColumn("rk", F.row_number().over(w))
    return (o if top is None else o.filter(F.col("rk") <= top)).select(
        "acct", F.col("rk").cast("bigint").alias("rk"), "party", "monthly_amount", "months_seen",
        "first_seen", "last_seen", "total_paid", active.alias("active"), fresh.alias("is_new"),
    )


def bounce_trend(days: DataFrame) -> DataFrame:
    """Bounces in the last 90 days against the 90 before."""
    end = days.groupBy("acct").agg(F.max("txn_date").alias("period_end"))
    age = F.datediff("period_end", "txn_date")
    return days.join(end, "acct").groupBy("acct").agg(
        _sum(age <= 89, F.col("bounces")).alias("bounces_last_90d"),
        _sum(age.between(90, 179), F.col("bounces")).alias("bounces_prior_90d"),
    )


def two_way_parties(df: DataFrame) -> DataFrame:
    """Parties large on both sides; the five with the largest smaller side."""
    total = df.groupBy("acct").agg(_sum(F.col("amount") > 0, F.col("amount")).alias("total"))
    bar = total.select("acct", F.greatest(F.lit(2_500_000.0), F.col("total") * 0.01).alias("bar"))
    amt = F.col("amount")
    large = (
        df.filter(F.col("party") != "").join(bar, "acct").filter(F.abs("amount") >= F.col("bar"))
        .groupBy("acct", party_key("party").alias("pkey"), "bar")
        .agg(_sum(amt > 0, amt).alias("credits"), _sum(amt < 0, -amt).alias("debits"))
    )
    small = F.least("credits", "debits")
    both = large.filter(small >= F.col("bar")).join(party_labels(df), ["acct", "pkey"], "left")
    w = Window.partitionBy("acct").orderBy(small.desc(), "pkey")
    return both.withColumn("rk", F.row_number().over(w)).filter("rk <= 5").select(
        "acct", F.col("rk").cast("bigint").alias("rk"), F.col("label").alias("party"), "credits", "debits"
    )


def high_risk_spend(df: DataFrame) -> DataFrame:
    """Speculative spending per group."""
    out = df.filter(F.col("amount") < 0).withColumn("risk_group", high_risk_group("description"))
    return out.filter(F.col("risk_group").isNotNull()).groupBy("acct", "risk_group").agg(
        F.count(F.lit(1)).alias("n"), (-F.sum("amount")).alias("spent")
    )


def credit_summary(df: DataFrame) -> DataFrame:
    """One row per account with every scalar metric."""
    days = daily(df)
    out = account_totals(days)
    for part in (
        balance_stats(days), turnover_trend(monthly_flow(days)), balance_stability(days),
        bounce_trend(days), concentration(df).drop("top_credit_parties"),
    ):
        out = out.join(part, "acct", "left")
    obligations = emi_obligations(df, top=None).groupBy("acct").agg(
        F.count_if("active").alias("active_emis"), F.count_if("is_new").alias("new_emis"),
        _sum(F.col("active"), F.col("monthly_amount")).alias("active_emi_total"),
    )
    both = two_way_parties(df).groupBy("acct").agg(
        F.count(F.lit(1)).alias("two_way_n"),
        F.min_by(F.struct("party", "credits", "debits"), "rk").alias("two_way_top"),
    )
    entry = F.struct((-F.col("spent")).alias("k"), F.col("risk_group").alias("g"), "n", "spent")
    risk = high_risk_spend(df).groupBy("acct").agg(F.array_sort(F.collect_list(entry)).alias("risk"))
    for part in (obligations, both, risk):
        out = out.join(part, "acct", "left")
    return out


def reads(summary: DataFrame, status: str = "status", integrity: str | None = None) -> DataFrame:
    """Plain-language messages in fixed order."""
    c = F.col
    rupees = lambda x: F.format_string("%.0f", x / 100.0)
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    n_active = F.coalesce(c("active_emis"), F.lit(0))
    n_new = F.coalesce(c("new_emis"), F.lit(0))
    risk_text = F.array_join(
        F.transform("risk", lambda x: F.concat(F.lower(x["g"]), F.lit(" ("), x["n"].cast("string"), F.lit(" txn, "), rupees(x["spent"]), F.lit(")"))),
        "; ",
    )
    share, lowp, cov = c("top_party_share_pct"), c("low_days_pct"), c("servicing_coverage")
    added = F.when(n_new > 0, text(", ", n_new, " added in the last quarter.")).otherwise(".")
    lines = [
        F.when(c(status) != "passed", "Balance does not reconcile on every row — treat totals as provisional until the source document is complete."),
        F.when(c(integrity) == "review", "Statement integrity flagged for review — see the integrity notes before relying on this account.") if integrity else None,
        F.when(c("bounces") > 0, text(c("bounces"), " bounce/return event(s) in ", c("months"), " month(s) — a cheque/mandate discipline signal.")),
        F.when((c("bounces_last_90d") >= 2) & (c("bounces_last_90d") > c("bounces_prior_90d")), text("Bounces are increasing: ", c("bounces_last_90d"), " in the last 90 days vs ", c("bounces_prior_90d"), " in the 90 days before — recent cheque/mandate failures, not old history.")),
        F.when(c("cash_intensity_pct") >= 40, text("Cash-intensive: ", c("cash_intensity_pct"), "% of turnover is cash deposits — turnover is harder to verify independently.")),
        F.when(c("avg_balance") < 0, "Average balance is negative — an overdraft / CC account operating in the drawn range."),
        F.when((c("emi_out") > 0) & (c("emi_out_monthly") > c("avg_monthly_turnover") * 0.5), text("EMI/interest outflow (~", rupees(c("emi_out_monthly")), "/mo) is a large share of monthly turnover — limited headroom for new EMI.")),
        F.when(n_active > 0, text(n_active, " EMI obligation(s) active at period end (~", rupees(c("active_emi_total")), "/mo combined)", added)),
        F.when(share >= 50, text("Credit concentration: the top counterparty is ", share, "% of all credits — revenue depends heavily on one source."))
        .when(share > 40, text("Credit concentration: the top counterparty is ", share, "% of all credits (top 3: ", c("top3_party_share_pct"), "%) — revenue leans on one customer.")),
        F.when(c("two_way_n") > 0, text("Funds move both ways with ", c("two_way_n"), " counterpart(y/ies) — e.g. ", c("two_way_top.party"), ": ", rupees(c("two_way_top.credits")), " in / ", rupees(c("two_way_top.debits")), " out — worth confirming these are arm's-length trade flows.")),
        F.when(c("related_credit_pct") >= 25, text(c("related_credit_pct"), "% of credits are from related parties — may overstate genuine third-party turnover.")),
        F.when(c("turnover_trend") == "declining", "Turnover is declining over the period — business credits in the later months are materially below the earlier ones.")
        .when(c("turnover_trend") == "rising", "Turnover is rising over the period — a positive trend."),
        F.when(c("last_quarter_change_pct") <= -30, text("Turnover in the last quarter averages ", rupees(c("last3_avg")), "/mo vs ", rupees(c("prior_avg")), "/mo earlier — down ", -c("last_quarter_change_pct"), "%.")),
        F.when(c("balance_stability_cv") > 0.6, "Balance swings widely month to month — low liquidity stability, worth probing before relying on the average."),
        F.when(lowp >= 25, text("Balance sits below ", rupees(c("low_threshold")), " on ", lowp, "% of days (longest continuous stretch: ", c("longest_low_streak"), " day(s)) — a thin liquidity buffer.")),
        F.when(cov < 1.5, text("Debt-service coverage is tight (inflow is ~", cov, "× existing EMI outflow) — little room for additional debt.")),
        F.when(F.size("risk") > 0, text("Speculative / high-risk spending seen: ", risk_text, " — diversion of working capital, verify with the borrower.")),
    ]
    said = F.array_compact(F.array(*[x for x in lines if x is not None]))
    none = F.array(F.lit("No adverse signals detected on the deterministic checks."))
    return summary.withColumn("reads", F.when(F.size(said) > 0, said).otherwise(none))
