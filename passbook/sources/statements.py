"""Statement-level data derived from the ledger: headers, footers, raw printed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["acct", "file_idx"]

# Printed date shapes used by the derived statements, by account.
PRINTED_DATES = ["dd/MM/yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "yyyy-MM-dd", "dd.MM.yyyy"]
LAYOUTS = [
    "plain_account_statement", "plain_savings_statement", "plain_current_statement",
    "plain_od_statement", "plain_cash_credit",
]
FOOTER_PATTERN = r"Dr Count:\s*([\d,]+)\s+Cr Count:\s*([\d,]+)\s+Total:\s*([\d,]+)\s+Debits:\s*([\d,.]+)"


def totals(df: DataFrame) -> DataFrame:
    debit, credit = F.col("side") == "debit", F.col("side") == "credit"
    return df.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(debit).alias("nd"), F.count_if(credit).alias("nc"),
        F.sum(F.when(debit, -F.col("amount"))).alias("sd"), F.sum(F.when(credit, F.col("amount"))).alias("sc"),
    )


def declared(df: DataFrame) -> DataFrame:
    """Declared totals per statement: some short by a row, some by an amount, some absent."""
    k = F.col("acct") % 5
    null = F.lit(None).cast("bigint")
    return totals(df).select(
        "acct",
        F.when(k.isin(0, 1), F.col("n") + F.when(k == 1, 1).otherwise(0)).otherwise(null).alias("d_txns"),
        F.when(k.isin(2, 3), F.col("nd") + F.when(k == 3, 1).otherwise(0)).otherwise(null).alias("d_debits"),
        F.when(k.isin(2, 3), F.col("nc")).otherwise(null).alias("d_credits"),
        F.when(k == 2, F.col("sd") + 100_000).otherwise(null).alias("d_sum_debits"),
        F.when(k == 2, F.col("sc")).otherwise(null).alias("d_sum_credits"),
    )


def footers(df: DataFrame) -> DataFrame:
    """A printed footer per statement and the layout pattern that reads it."""
    num = lambda c: F.format_number(F.col(c), 0)
    footer = F.concat(
        F.lit("Statement summary Dr Count: "), num("nd"), F.lit("  CR COUNT: "), num("nc"), F.lit(" Total: "),
        num("n"), F.lit(" Debits: "), F.format_number(F.coalesce("sd", F.lit(0)) / 100.0, 2), F.lit(" END"),
    )
    spots = {"n_debits": 1, "n_credits": 2, "n_txns": 3, "sum_debits": 4}
    position = F.create_map(*[x for k, v in spots.items() for x in (F.lit(k), F.lit(v))])
    return totals(df).select(
        *FILE, footer.alias("footer"), F.lit(FOOTER_PATTERN).alias("pattern"), position.alias("position")
    )


def headers(df: DataFrame) -> DataFrame:
    """One header per statement with document metadata."""
    acct, year = F.col("acct"), F.col("file_idx")
    base = df.groupBy("job_id", "bank", "account_no", *FILE).agg(
        F.min("txn_date").alias("period_from"), F.max("txn_date").alias("period_to"),
        F.max("page").alias("n_pages"), F.count(F.lit(1)).alias("n_rows"),
    )
    layouts = F.array(*[F.lit(x) for x in LAYOUTS])
    return base.select(
        "*",
        F.element_at(layouts, (acct % 5 + 1).cast("int")).alias("layout"),
        F.concat(F.lit("M/S. HOLDER "), acct.cast("string"), F.lit(" PRIVATE LIMITED")).alias("account_name"),
        F.concat_ws("-", F.col("account_no"), year.cast("string")).alias("source_file"),
        F.when(acct % 6 == 1, "Adobe Photoshop 24.1").otherwise("iText 7.2").alias("producer"),
        F.lit("bank export").alias("creator"),
        F.concat(F.lit("D:"), F.date_format("period_to", "yyyyMMdd"), F.lit("100000")).alias("pdf_created"),
        F.concat(F.lit("D:"), F.date_format(F.date_add("period_to", 3), "yyyyMMdd"), F.lit("110000")).alias("pdf_modified"),
        F.when((year % 4 == 0) & (acct % 3 == 0), F.array(F.lit(2), F.lit(5))).otherwise(F.array().cast("array<int>"))
        .alias("unreadable_pages"),
        F.lit(True).alias("is_digital_text"),
    )


def raw_rows(df: DataFrame) -> DataFrame:
    """Printed rows of overlapping statements.

    A statement covers a year and the January after it, so neighbours share rows. Dates
    come in five shapes, some statements run newest first, texts carry stray spaces and a
    control byte, and each statement has a brought-forward row and a balance-only row.
    """
    year = F.year("txn_date")
    files = F.when(F.month("txn_date") == 1, F.array(year, year - 1)).otherwise(F.array(year))
    rows = df.drop("file_idx").withColumn("file_idx", F.explode(files)).withColumn("at", F.col("row_seq") * 2)
    amt = F.col("amount")
    plain = ((amt < 0) & (F.col("side") == "debit")) | ((amt > 0) & (F.col("side") == "credit"))
    both = plain & (F.col("row_seq") % 97 == 0)
    money = lambda c: (c / 100).cast("decimal(18,2)")
    wd = F.when(both, F.when(amt < 0, -amt + 100).otherwise(100)).when(F.col("side") == "debit", -amt)
    dep = F.when(both, F.when(amt > 0, amt + 100).otherwise(100)).when(F.col("side") == "credit", amt)
    ident = ["acct", "job_id", "bank", "account_no", "file_idx"]
    body = rows.select(
        *ident, "at", "txn_date", F.concat(F.lit("  "), F.replace(F.col("description"), F.lit(" "), F.lit("  ")), F.lit("\x07 ")).alias("description"),
        money(wd).alias("withdrawal"), money(dep).alias("deposit"), money(F.col("balance")).alias("balance"),
        "page", F.lit(False).alias("is_opening"),
    )
    none = F.lit(None).cast("decimal(18,2)")
    delta = F.when(F.col("balance_inverted"), -amt).otherwise(amt)
    ends = rows.groupBy(*ident).agg(
        F.min_by(F.struct("at", "txn_date", (F.col("balance") - delta).alias("balance"), "page"), "at").alias("lo"),
        F.max_by(F.struct("at", "txn_date", "balance", "page"), "at").alias("hi"),
    )

    def edge(name: str, step: int, text: str, opening: bool) -> DataFrame:
        return ends.select(
            *ident, (F.col(f"{name}.at") + step).alias("at"), f"{name}.txn_date", F.lit(text).alias("description"),
            none.alias("withdrawal"), none.alias("deposit"), money(F.col(f"{name}.balance")).alias("balance"),
            f"{name}.page", F.lit(opening).alias("is_opening"),
        )

    out = body.unionByName(edge("lo", -1, "B/F", True)).unionByName(edge("hi", 1, "Closing balance", False))
    shape = (F.col("acct") % 5).cast("int")
    printed = None
    for i, p in enumerate(PRINTED_DATES):
        text = F.date_format("txn_date", p)
        printed = F.when(shape == i, text) if printed is None else printed.when(shape == i, text)
    newest_first = F.col("acct") % 7 == 0
    return out.select(
        *ident, F.when(newest_first, -F.col("at")).otherwise(F.col("at")).alias("printed_seq"),
        printed.alias("date"), "description", "withdrawal", "deposit", "balance", "page", "is_opening",
    )
