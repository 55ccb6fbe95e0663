"""Categorisation passes that need more than one row, and the whole tagging step."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions import category as C
from passbook.functions.narration import with_narration
from passbook.functions.party import bank_from_code
from passbook.functions.subcategory import credit_side, with_subcategory
from passbook.functions.text import gated_hit, hit, squash
from passbook.operators.ordered import with_running
from passbook.session import dense, small_side, stage
from passbook.vocab import keywords as K

NOT_EMI_GATE = "RENT|ADVANCE|DRIVER|SALARY|WAGE|HOUSE|MAINTEN"
ORDER = ["txn_date", "file_idx", "row_seq"]


def solid_party(party: str = "party") -> Column:
    return F.replace(F.upper(F.coalesce(F.col(party), F.lit(""))), F.lit(" "), F.lit(""))


def recurring_series(df: DataFrame) -> DataFrame:
    """One row per (account, party, amount) series that repeats like an instalment.

    Rows are first folded to one per calendar month, so a huge series is combined on
    the map side and the second level is bounded by the months of an account. A series whose
    name or amount bars a cadence can only be a mandate's, so its other rows are left out.
    """
    apt = (
        (F.col("amount") <= -50_000)
        & (F.col("amount") % 50_000 != 0)
        & (F.length("solid") >= 4)
        & (F.col("solid") != "UNKNOWNPARTY")
    )
    month = (F.year("txn_date") * 12 + F.month("txn_date")).alias("month")
    debits = df.filter(F.col("amount") < 0).select(
        "acct", solid_party().alias("solid"), "amount", month, "mode", "party", *ORDER,
        F.dayofmonth("txn_date").alias("day"),
        gated_hit(F.upper("description"), F.col("description"), C.NOT_EMI, NOT_EMI_GATE).alias("other_use"),
    )
    monthly = debits.where(apt | (F.col("mode") == "nach")).groupBy("acct", "solid", "amount", "month").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("mode") == "nach").alias("nach"),
        F.min("day").alias("lo"),
        F.max("day").alias("hi"),
        F.max("other_use").alias("other_use"),
        F.min(F.struct(*ORDER, "party")).alias("first"),
    )
    series = monthly.groupBy("acct", "solid", "amount").agg(
        F.count_if("nach").alias("nach_months"),
        F.count(F.lit(1)).alias("months"),
        F.sum("n").alias("n"),
        (F.max("month") - F.min("month")).alias("span"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max("other_use").alias("other_use"),
        F.min("first").alias("first"),
    )
    cadence = (
        apt
        & (F.col("months") >= 3)
        & (F.col("n") <= F.col("months") + 1)
        & (F.col("span") == F.col("months") - 1)
        & (F.col("hi") - F.col("lo") <= 7)
        & ~F.col("other_use")
        & ~hit("first.party", r"\bBANK\b")
    )
    return series.select(
        "acct", "solid", "amount", (F.col("nach_months") >= 3).alias("rec_nach"),
        cadence.alias("rec_emi"),
    ).filter("rec_nach or rec_emi")


def with_recurrence(df: DataFrame) -> DataFrame:
    """Mark rows of mandate series (``rec_nach``) and monthly cadences (``rec_emi``).

    The series are written first: guessed from the plan, their size grows with the ledger,
    which would then be shuffled and sorted with its texts to meet a few of them.
    """
    series = stage(recurring_series(df), "series")
    flagged = df.withColumn("solid", solid_party()).join(small_side(series), ["acct", "solid", "amount"], "left")
    return flagged.select(
        *df.columns,
        (F.coalesce("rec_nach", F.lit(False)) & (F.col("mode") == "nach")).alias("rec_nach"),
        F.coalesce("rec_emi", F.lit(False)).alias("rec_emi"),
    )


def with_lender(df: DataFrame, lenders: list[str] | None = None) -> DataFrame:
    """Lender named in the bank-printed part of the narration (``lender``, nullable).

    Only rows that print a lender's name anywhere are parsed into parts.
    """
    keep = [c for c in df.columns if c != "lender"]
    df = df.withColumn("__any", C.lender_in("description", lenders).isNotNull())
    df = with_narration(df, out="__narr", needed=F.col("__any"))
    shouted = ~F.col("__narr.remark").rlike("[a-z]") & (F.col("__narr.remark") != "")
    found = F.coalesce(
        C.lender_in("__narr.structured", lenders),
        F.when(shouted, C.lender_in("__narr.remark", lenders)),
    )
    fee_row = F.col("description").rlike(r"(?:^|[\s/-])CHG[/\s-]")
    return df.select(*keep, F.when(F.col("__any") & ~fee_row, found).alias("lender"))


def holder_stems(holder: Column) -> Column:
    """Distinctive words of the account holder's name."""
    words = F.split(F.upper(F.coalesce(holder, F.lit(""))), "[^A-Za-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin(K.LEGAL_FORM))


@F.pandas_udf(T.BooleanType())
def own_name(key: pd.Series, stems: pd.Series) -> pd.Series:
    """Is the squashed party close to the head of a holder word? Null keys are skipped."""

    def close(k, words) -> bool:
        if k is None or words is None or len(k) < 5:
            return False
        heads = [w[: len(k)] for w in words]
        return any(
            len(h) >= 5 and (k == h or SequenceMatcher(None, k, h).ratio() >= 0.8) for h in heads
        )

    return pd.Series([close(k, w) for k, w in zip(key, stems, strict=True)])


def tag_rows(
    df: DataFrame,
    related: list[str] | None = None,
    holder: str | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Add category, category_source and confidence; may rename a weak party."""
    base = df.columns
    df = with_lender(with_recurrence(df))
    weak = F.upper(F.trim(F.coalesce("party", F.lit("")))).isin(K.WEAK_PARTY)
    df = df.withColumn("party", F.when(F.col("lender").isNotNull() & weak, F.col("lender")).otherwise(F.col("party")))
    df = df.withColumn("__cr", credit_side())
    d, mode, credit = F.col("description"), F.col("mode"), F.col("__cr")
    df = df.withColumn("__up", F.upper("description")).withColumn("__named", squash("description"))
    up = F.col("__up")
    df = df.withColumn("__tier", C.rule_tag(d, up, F.col("__named"), mode, credit, F.col("lender")))
    tier, mandate = F.col("__tier"), F.col("__tier") == C.MANDATE_TIER
    app = squash("party").isin(K.PAYMENT_APPS)
    bank = F.when(
        (tier == C.INSTALMENT_TIER) & ((F.coalesce("party", F.lit("")) == "") | app), bank_from_code(d)
    )
    df = df.withColumn("__bank", bank)
    df = df.withColumn("party", F.coalesce(F.expr("nullif(__bank, '')"), F.col("party"), F.lit("")))
    df = df.withColumn(
        "__tag",
        F.when(mandate, F.when(F.col("rec_nach"), K.EMI).otherwise(K.ECS))
        .when(tier == C.INSTALMENT_TIER, K.EMI)
        .otherwise(tier),
    )
    by_series = mandate & F.col("rec_nach")
    df = df.withColumn("__src", F.when(by_series, "recurrence").otherwise("rule"))
    df = df.withColumn("__solid", solid_party())
    if dictionary is not None:
        # The optimizer writes out what it knows of a join's sides, each alias replaced in every
        # other: over the cascade that outgrows the driver, however few the rows.
        with dense(df.sparkSession):
            df = stage(df, "ruled")
        look = dictionary.select(
            F.col("party").alias("__solid"), F.col("credit").alias("__dc"), F.col("debit").alias("__dd")
        )
        df = df.join(small_side(look), "__solid", "left")
        known = F.when(credit, F.col("__dc")).otherwise(F.col("__dd"))
        listed = F.col("__tag").isNull() & known.isNotNull() & (F.col("__solid") != "")
        df = df.withColumn("__src", F.when(listed, "dictionary").otherwise(F.col("__src")))
        df = df.withColumn("__tag", F.when(listed, F.expr("nullif(case when __cr then __dc else __dd end, '')")).otherwise(F.col("__tag")))
    kin = F.when(credit, K.RELATED_IN).otherwise(K.RELATED_OUT)
    solid = F.col("__solid")
    names = [squash_spaces(r) for r in related or []]
    is_kin = F.lit(False)
    for r in names:
        is_kin = is_kin | solid.contains(r) | F.lit(r).contains(solid)
    is_kin = is_kin & (solid != "")
    own = gated_hit(up, d, C.any_of(C.SELF_TRANSFER), "SELF|OWN|FAMILY")
    open_row = F.col("__tag").isNull() | F.col("__tag").isin(K.REGULAR_IN, K.REGULAR_OUT)
    open_row = open_row & ~is_kin & ~gated_hit(up, d, C.THIRD_PARTY_CHANNEL, "TPT")
    if holder:
        probe = open_row & hit(d, C.OWN_CHANNEL)
        df = df.withColumn("__own", own_name(F.when(probe, squash("party")), holder_stems(F.col(holder))))
        own = own | F.coalesce("__own", F.lit(False))
    df = df.withColumn("__kin", is_kin).withColumn("__self", open_row & own)
    # Written here: a filter on the tag would else be pushed through the whole cascade,
    # and its nested cases copied into each other until the optimizer gives up.
    with dense(df.sparkSession):
        df = stage(df, "cascade")
    credit = F.col("__cr")
    cadence = F.col("__tag").isNull() & ~credit & F.col("rec_emi")
    tag = (
        F.when(F.col("__kin") | F.col("__self"), kin)
        .when(cadence, K.EMI)
        .otherwise(F.coalesce("__tag", F.when(credit, K.REGULAR_IN).otherwise(K.REGULAR_OUT)))
    )
    src = (
        F.when(F.col("__kin"), "related-party")
        .when(F.col("__self"), "own-account")
        .when(cadence, "recurrence-cadence")
        .when(F.col("__tag").isNull(), "fallback")
        .otherwise(F.col("__src"))
    )
    df = df.withColumn("category", tag).withColumn("category_source", src)
    named = ~F.upper(F.trim("party")).isin(K.WEAK_PARTY)
    confidence = (
        F.when(F.col("category_source") == "recurrence-cadence", "medium")
        .when(F.col("category_source") != "fallback", "high")
        .when(named, "medium")
        .otherwise("low")
    )
    return df.select(*base, "category", "category_source", confidence.alias("confidence"))


def squash_spaces(s: str) -> str:
    return "".join(s.split()).upper()


def reversal_counts(df: DataFrame) -> DataFrame:
    """How many machine credits each bucket's debits can absorb, per day.

    A bucket is one account, text and size. Every credit takes the first unused debit
    within a day of it, in date order, so only day counts matter: the fold carries what
    is left of yesterday and today. A bucket folds at most one entry per calendar day.
    """
    size = F.abs("amount").alias("size")
    days = (
        df.filter(F.col("mode") == "atm-cash")
        .groupBy("acct", "description", size, "txn_date")
        .agg(
            F.count_if(F.col("amount") < 0).alias("outs"),
            F.count_if(F.col("amount") > 0).alias("ins"),
        )
    )
    bucket = Window.partitionBy("acct", "description", "size").orderBy("txn_date")
    gap = lambda c: F.datediff(c, "txn_date")
    days = days.select(
        "*",
        F.when(gap(F.lead("txn_date").over(bucket)) == 1, F.lead("outs").over(bucket))
        .otherwise(0).alias("next_outs"),
        (F.datediff("txn_date", F.lag("txn_date").over(bucket)) == 1).alias("joined"),
    )
    days = days.withColumn("joined", F.coalesce("joined", F.lit(False)))
    entry = F.struct("txn_date", "outs", "ins", "next_outs", "joined")
    folded = days.groupBy("acct", "description", "size").agg(
        F.array_sort(F.collect_list(entry)).alias("days")
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("borrowed"),
        F.array().cast("array<struct<txn_date:date,paired:bigint>>").alias("done"),
    )

    def step(acc: Column, x: Column) -> Column:
        before = F.when(x["joined"], acc["left"]).otherwise(F.lit(0))
        today = x["outs"] - F.when(x["joined"], acc["borrowed"]).otherwise(F.lit(0))
        m1 = F.least(x["ins"], before)
        m2 = F.least(x["ins"] - m1, today)
        m3 = F.least(x["ins"] - m1 - m2, x["next_outs"])
        return F.struct(
            (today - m2).cast("bigint").alias("left"), m3.cast("bigint").alias("borrowed"),
            F.concat(
                acc["done"],
                F.array(F.struct(x["txn_date"].alias("txn_date"), (m1 + m2 + m3).cast("bigint").alias("paired"))),
            ).alias("done"),
        )

    return folded.select(
        "acct", "description", "size", F.explode(F.aggregate("days", start, step)["done"]).alias("d")
    ).select("acct", "description", "size", "d.txn_date", "d.paired").filter("paired > 0")


def flag_reversals(df: DataFrame) -> DataFrame:
    """Relabel the money-in leg of a failed machine withdrawal."""
    ins = F.coalesce((F.col("mode") == "atm-cash") & (F.col("amount") > 0), F.lit(False))
    base = df.columns
    if "sub_category" not in base:
        df = df.withColumn("sub_category", F.lit(""))
        base = [*base, "sub_category"]
    paired = stage(reversal_counts(df), "reversals")
    # Only money in from a machine can be relabelled; the other rows need no shuffle.
    rows = df.where(ins).withColumn("size", F.abs("amount"))
    rows = rows.join(small_side(paired), ["acct", "description", "size", "txn_date"], "left")
    day = Window.partitionBy("acct", "description", "size", "txn_date").orderBy("file_idx", "row_seq")
    rows = rows.withColumn("__rev", F.row_number().over(day) <= F.coalesce("paired", F.lit(0)))
    change = {
        "category": K.REFUND, "category_source": "atm-reversal", "party": "Reversals & refunds",
        "sub_category": "Reversals & refunds",
    }
    rows = rows.select(
        *[F.when(F.col("__rev"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in base]
    )
    return df.where(~ins).select(*base).unionByName(rows)


def categorise(
    df: DataFrame,
    related: list[str] | None = None,
    holder: str | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Tags, machine reversals and sub-categories for a party-resolved ledger."""
    tagged = flag_reversals(tag_rows(df, related, holder, dictionary))
    return with_subcategory(tagged, override="sub_category")
