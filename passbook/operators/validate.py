"""Ledger checks: running balance, date order, declared totals, document integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.subcategory import credit_side
from passbook.operators.ordered import row_block, with_previous
from passbook.session import small_side
from passbook.vocab import keywords as K

TOLERANCE_PAISE = 1.1
GAP_DAYS = 20
FILE = ["acct", "file_idx"]


def with_file(df: DataFrame) -> DataFrame:
    """Statement id and the row block that statement windows are split by."""
    file_id = F.concat_ws("-", "account_no", F.col("file_idx").cast("string"))
    return df.withColumn("file_id", file_id).withColumn("block", row_block())


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def chain_breaks(df: DataFrame, key: list[str], seg: str, order: list[str]) -> DataFrame:
    """Each row against the *printed* balance before it, so one break is one issue.

    Opening rows re-base the chain and are never checked. An inverted account prints what
    is owed, so its balance moves against the amount.
    """
    opening = _optional(df, "is_opening", False)
    tol = F.greatest(F.lit(TOLERANCE_PAISE), _optional(df, "balance_tolerance", 0.0).cast("double"))
    delta = F.when(_optional(df, "balance_inverted", False), -F.col("amount")).otherwise(F.col("amount"))
    df = with_previous(df, key, seg, order, {"prev_balance": "balance", "prev_date": "txn_date"})
    expected = F.col("prev_balance") + delta
    off = F.abs(expected - F.col("balance")) > tol
    known = F.col("prev_balance").isNotNull() & ~opening
    return (
        df.withColumn("delta", delta).withColumn("expected", expected)
        .withColumn("broken", F.coalesce(known & off, F.lit(False)))
        .withColumn("disordered", F.coalesce((F.col("txn_date") < F.col("prev_date")) & ~opening, F.lit(False)))
        .withColumn("gap_days", F.abs(F.datediff("txn_date", "prev_date")))
    )


def file_issues(df: DataFrame) -> DataFrame:
    """One row per issue of every statement, checked statement by statement."""
    rows = chain_breaks(df, FILE, "block", ["row_seq"])
    money = lambda c: F.format_string("%.2f", F.col(c) / 100.0)
    text = F.concat(
        F.lit("prev "), money("prev_balance"), F.lit(" + amount "),
        F.format_string("%+.2f", F.col("delta") / 100.0), F.lit(" = "), money("expected"),
        F.lit(", statement says "), money("balance"), F.lit(" ("), F.col("txn_date").cast("string"),
        F.lit(" "), F.substring("description", 1, 60), F.lit(")"),
        F.when(F.col("gap_days") > GAP_DAYS, F.concat(
            F.lit(" — "), F.col("gap_days").cast("string"),
            F.lit(" days pass since the previous row, so either pages are missing or rows were not extracted"),
        )).otherwise(""),
    )
    late = F.concat(F.col("txn_date").cast("string"), F.lit(" before previous "), F.col("prev_date").cast("string"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("broken"), F.struct(F.lit("balance_mismatch").alias("kind"), text.alias("detail"))),
            F.when(F.col("disordered"), F.struct(F.lit("date_order").alias("kind"), late.alias("detail"))),
        )
    )
    hits = rows.filter(F.col("broken") | F.col("disordered"))
    return hits.select(
        *FILE, "row_seq", "gap_days", F.explode(kinds).alias("i")
    ).select(*FILE, "row_seq", "gap_days", "i.kind", "i.detail")


def statement_status(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """Worst kind of issue per statement."""
    worst = issues.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("issues"), F.max(F.col("kind") == "balance_mismatch").alias("broken")
    )
    files = rows.groupBy(*FILE).agg(F.count(F.lit(1)).alias("checked_rows"))
    status = (
        F.when(F.col("broken"), "failed").when(F.col("issues") > 0, "passed_with_warnings").otherwise("passed")
    )
    return files.join(worst, FILE, "left").select(
        *FILE, "checked_rows", F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues"), status.alias("status")
    )


def account_status(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """An account takes the worst status among its statements."""
    s = statement_status(issues, rows)
    rank = (
        F.when(F.col("status") == "failed", 2).when(F.col("status") == "passed_with_warnings", 1).otherwise(0)
    )
    a = s.groupBy("acct").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("issues").alias("issues"), F.max(rank).alias("r")
    )
    return a.select(
        "acct", "statements", "issues",
        F.when(F.col("r") == 2, "failed").when(F.col("r") == 1, "passed_with_warnings")
        .otherwise("passed").alias("status"),
    )


def issue_kinds(issues: DataFrame) -> DataFrame:
    """E5: counts per kind as a map; kinds are few, so the map is bounded."""
    per = issues.groupBy("acct", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("acct").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds")
    )


def issue_sample(issues: DataFrame, n: int = 5) -> DataFrame:
    """E5: the first few issues of each account."""
    w = Window.partitionBy("acct").orderBy("file_idx", "row_seq", "kind")
    return issues.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)


def side_totals(df: DataFrame) -> DataFrame:
    """Rows, counts and sums by printed column, the way a bank counts."""
    cr, amt = credit_side(), F.col("amount")
    return df.groupBy("acct").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~cr).alias("n_debits"), F.count_if(cr).alias("n_credits"),
        F.coalesce(F.sum(F.when(~cr, -amt)), F.lit(0)).alias("sum_debits"),
        F.coalesce(F.sum(F.when(cr, amt)), F.lit(0)).alias("sum_credits"),
    )


def completeness(df: DataFrame, declared: DataFrame) -> DataFrame:
    """Extracted totals against the declared ones, summed over an account's statements.

    ``declared`` has acct, d_txns, d_debits, d_credits, d_sum_debits, d_sum_credits; any
    of them may be null.
    """
    cols = ["d_txns", "d_debits", "d_credits", "d_sum_debits", "d_sum_credits"]
    d = declared.groupBy("acct").agg(*[F.sum(c).alias(c) for c in cols])
    j = side_totals(df).join(d, "acct", "left")
    expected = F.coalesce(F.col("d_txns"), F.col("d_debits") + F.col("d_credits"))
    off = lambda got, want: F.coalesce(
        F.abs(F.col(got) - F.col(want)) > F.greatest(F.lit(500.0), F.abs(F.col(want)) * 0.0002), F.lit(False)
    )
    checked = F.greatest(*[F.col(c).isNotNull() for c in cols])
    count_off = F.coalesce(expected != F.col("n_rows"), F.lit(False))
    gap = expected - F.col("n_rows")
    complete = ~(count_off | off("sum_debits", "d_sum_debits") | off("sum_credits", "d_sum_credits"))
    return j.select(
        "acct", "n_rows", "n_debits", "n_credits", "sum_debits", "sum_credits", checked.alias("checked"),
        F.when(checked, complete).alias("complete"),
        F.when(count_off, gap).cast("bigint").alias("missing_rows"),
        off("sum_debits", "d_sum_debits").alias("debits_off"),
        off("sum_credits", "d_sum_credits").alias("credits_off"),
    )


# The groups a layout's summary pattern may capture, in this order.
DECLARED_GROUPS = ["n_txns", "n_debits", "n_credits", "sum_debits", "sum_credits"]


def declared_totals(text: Column, pattern: Column, position: Column) -> Column:
    """Struct of declared totals from footer text.

    ``pattern`` and ``position`` come with the layout row: ``position`` maps a group name
    to its number in the pattern.
    """
    at = lambda name: F.element_at(position, name)
    hit = F.regexp_like(text, F.concat(F.lit("(?i)"), pattern))

    def group(name: str, kind: str) -> Column:
        raw = F.call_function(
            "regexp_extract", text, F.concat(F.lit("(?i)"), pattern), F.coalesce(at(name), F.lit(0))
        )
        value = F.trim(F.replace(raw, F.lit(","), F.lit("")))
        return F.when(hit & at(name).isNotNull(), value.try_cast(kind)).alias(name)

    return F.struct(
        *[group(n, "bigint") for n in DECLARED_GROUPS[:3]],
        *[group(n, "decimal(18,2)") for n in DECLARED_GROUPS[3:]],
    )


def statement_flags(statements: DataFrame) -> DataFrame:
    """Authenticity flags of one source statement."""
    combo = F.lower(F.concat_ws(" ", "producer", "creator"))
    tool = F.coalesce(*[F.when(combo.contains(t), F.lit(t)) for t in K.EDITING_TOOLS])
    unread = F.size(F.coalesce("unreadable_pages", F.array().cast("array<int>")))
    src = F.col("source_file")
    flags = F.array_compact(
        F.array(
            F.when(tool.isNotNull(), F.concat(src, F.lit(": created with an editing tool ("), tool, F.lit("), not a bank's statement generator"))),
            F.when(unread > 0, F.concat(src, F.lit(": "), unread.cast("string"), F.lit(" page(s) have no text layer — a scanned image spliced into a digital export")))
            .when(~F.col("is_digital_text"), F.concat(src, F.lit(": no text layer at all (a scan)"))),
        )
    )
    stamp = lambda c: F.try_to_timestamp(
        F.rpad(F.regexp_extract(c, r"D:(\d{8,14})", 1), 14, "0"), F.lit("yyyyMMddHHmmss")
    )
    days = F.floor((stamp("pdf_modified").cast("bigint") - stamp("pdf_created").cast("bigint")) / 86400)
    return statements.withColumn("flags", flags).withColumn(
        "modified_gap_days", F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("bigint")
    )


def account_integrity(statements: DataFrame, status: DataFrame) -> DataFrame:
    """Verified only when the chain reconciles and no statement raises a flag."""
    flagged = statement_flags(statements).filter(F.size("flags") > 0)
    per = flagged.groupBy("acct").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "flags"))), lambda x: x["flags"])).alias("f")
    )
    ok = F.col("status") == "passed"
    reason = F.array(F.lit("the running balance does not reconcile — a doctored amount or a missing page will both do this"))
    none = F.array().cast("array<string>")
    flags = F.concat(F.when(ok, none).otherwise(reason), F.coalesce("f", none))
    return status.join(small_side(per), "acct", "left").select(
        "acct", ok.alias("balance_verified"), flags.alias("flags"),
        F.when(F.size(flags) == 0, "verified").otherwise("review").alias("assessment"),
    )
