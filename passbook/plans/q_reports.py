"""Report-table queries and their oracles."""

from pyspark.sql import functions as F

from passbook.operators import metrics as M
from passbook.operators import reports as R
from passbook.plans import stages
from passbook.plans.oracle_base import TAGGED, with_ctes
from passbook.plans.q_metrics import DAILY, PARTY, PKEY, TREND, days
from passbook.plans.registry import ORACLES, query
from passbook.sources import statements as S
from passbook.vocab import keywords as K

MONTHLY = DAILY + """,
mm AS (
  SELECT acct, CAST(date_trunc('month', txn_date) AS DATE) AS month,
    count(*) FILTER (amount > 0) AS n_in, coalesce(sum(amount) FILTER (amount > 0), 0) AS credits,
    count(*) FILTER (amount < 0) AS n_out, coalesce(-sum(amount) FILTER (amount < 0), 0) AS debits,
    count(*) FILTER (category = 'inward bounce penal charges') AS inward,
    count(*) FILTER (category IN ('EMI transaction','Salary paid','ECS transaction','Related party debit','Regular debit')) AS issued,
    count(*) FILTER (category = 'Outward Bounced Xns') AS outward,
    count(*) FILTER (category IN ('Related party credit','Regular credit')) AS deposited,
    count(*) FILTER (side = 'credit') AS sc, count(*) FILTER (side = 'debit') AS sd
  FROM tagged GROUP BY 1, 2),
mb AS (
  SELECT acct, CAST(date_trunc('month', day) AS DATE) AS month, CAST(round(CAST(sum(balance) AS DOUBLE) / count(*)) AS BIGINT) AS mean,
    max(balance) FILTER (day(day) = 1) AS b1, max(balance) FILTER (day(day) = 5) AS b5, max(balance) FILTER (day(day) = 10) AS b10,
    max(balance) FILTER (day(day) = 15) AS b15, max(balance) FILTER (day(day) = 25) AS b25,
    CAST(round(CAST(sum(balance) FILTER (day(day) IN (5, 15, 25)) AS DOUBLE) / count(*) FILTER (day(day) IN (5, 15, 25))) AS BIGINT) AS a3,
    CAST(round(CAST(sum(balance) FILTER (day(day) IN (1, 10, 15, 25)) AS DOUBLE) / count(*) FILTER (day(day) IN (1, 10, 15, 25))) AS BIGINT) AS a4
  FROM eod GROUP BY 1, 2),
g AS (SELECT mm.*, mb.* EXCLUDE (acct, month) FROM mm JOIN mb ON mb.acct = mm.acct AND mb.month = mm.month)"""

ITEMS = K.SUMMARY_ROWS
CELLS = ["b5", "b15", "b25", "a3", "mean", "n_in", "credits", "n_out", "debits", "inward", "issued",
         "CASE WHEN issued <> 0 THEN round(10000.0 * inward / issued) / 10000.0 ELSE 0 END", "outward", "deposited",
         "CASE WHEN deposited <> 0 THEN round(10000.0 * outward / deposited) / 10000.0 ELSE 0 END"]
LONG = " UNION ALL ".join(
    f"SELECT acct, month, {i + 1} AS item_no, '{item}' AS item, CAST({c} AS DOUBLE) AS value FROM g"
    for i, (item, c) in enumerate(zip(ITEMS, CELLS, strict=True))
)
TOTALS = " UNION ALL ".join(
    f"SELECT acct, CAST(NULL AS DATE), {i + 1}, '{item}', "
    + (
        f"CAST(round(avg({CELLS[i]})) AS DOUBLE)" if i < 5
        else "CASE WHEN sum(issued) <> 0 THEN round(10000.0 * sum(inward) / sum(issued)) / 10000.0 ELSE 0 END" if i == 11
        else "CASE WHEN sum(deposited) <> 0 THEN round(10000.0 * sum(outward) / sum(deposited)) / 10000.0 ELSE 0 END" if i == 14
        else f"CAST(sum({CELLS[i]}) AS DOUBLE)"
    )
    + " FROM g GROUP BY acct"
    for i, item in enumerate(ITEMS)
)


@query("summary_grid", with_ctes(f"{LONG} UNION ALL {TOTALS}", MONTHLY), ("month",))
def summary_grid(spark, sf):
    return R.summary_grid(days(spark, sf))


@query("eod_grid", with_ctes("""
SELECT m.acct, m.month, CAST(n AS INTEGER) AS day_no, e.balance
FROM mm m CROSS JOIN generate_series(1, 31) s(n)
LEFT JOIN eod e ON e.acct = m.acct AND date_trunc('month', e.day) = m.month AND day(e.day) = n""", MONTHLY), ("month", "balance"))
def eod_grid(spark, sf):
    return R.eod_grid(days(spark, sf))


@query("avg_balances", with_ctes("""
SELECT acct, month, b1, b10, b15, b25, a4 AS anchor_mean, CAST(credits AS BIGINT) AS inflow, CAST(debits AS BIGINT) AS outflow,
  CAST(credits - debits AS BIGINT) AS net_flow, inward AS inward_returns, outward AS outward_returns, sc AS no_of_credit, sd AS no_of_debit
FROM g""", MONTHLY), ("month", "b1", "b10", "b15", "b25", "anchor_mean"))
def avg_balances(spark, sf):
    return R.avg_balances(days(spark, sf))


DIRS = PARTY + f""",
dm AS (SELECT acct, CAST(date_trunc('month', txn_date) AS DATE) AS month, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS direction,
         {PKEY} AS pkey, CAST(sum(abs(amount)) AS BIGINT) AS amount FROM tagged WHERE party <> '' GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY acct, month, direction ORDER BY amount DESC, pkey) AS slot FROM dm),
dp AS (SELECT acct, direction, pkey, CAST(sum(amount) AS BIGINT) AS amount FROM dm GROUP BY ALL),
dq AS (SELECT *, row_number() OVER (PARTITION BY acct, direction ORDER BY amount DESC, pkey) AS rk FROM dp)"""


@query("top_parties_month", with_ctes("""
SELECT k.acct, k.month, k.direction, CAST(n AS INTEGER) AS slot, l.label AS party, d.amount
FROM (SELECT DISTINCT acct, month, direction FROM dm) k CROSS JOIN generate_series(1, 10) s(n)
LEFT JOIN dr d ON d.acct = k.acct AND d.month = k.month AND d.direction = k.direction AND d.slot = n
LEFT JOIN labels l ON l.acct = d.acct AND l.pkey = d.pkey""", DIRS), ("month", "amount"))
def top_parties_month(spark, sf):
    return R.top_parties_month(stages.tagged(spark, sf))


@query("top_parties_period", with_ctes("""
SELECT d.acct, d.direction, d.rk, l.label AS party, d.amount FROM dq d JOIN labels l ON l.acct = d.acct AND l.pkey = d.pkey WHERE rk <= 10""", DIRS))
def top_parties_period(spark, sf):
    return R.top_parties_period(stages.tagged(spark, sf)).withColumn("rk", F.col("rk").cast("bigint"))


DEST = "CASE category " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in K.DESTINATION_TABLES.items()) + " ELSE 'Other Xns' END"
ROUTED = PARTY + f""",
routed AS (
  SELECT t.*, tn AS table_name, row_number() OVER (PARTITION BY t.acct, tn ORDER BY row_seq) AS sl_no,
    CASE WHEN tn IN ('Regular Credits', 'Regular Debits', 'Xns') THEN coalesce(l.label, 'unknown party') END AS party_group,
    CASE WHEN sub_category <> '' THEN sub_category ELSE category END AS category_label
  FROM (SELECT *, {PKEY} AS pkey, unnest(CASE WHEN isodow(txn_date) = 7 THEN [{DEST}, 'Xns', 'SundayXns'] ELSE [{DEST}, 'Xns'] END) AS tn FROM tagged) t
  LEFT JOIN labels l ON l.acct = t.acct AND l.pkey = t.pkey)"""


@query("routed_rows", with_ctes("SELECT acct, table_name, sl_no, row_seq, party_group, category_label FROM routed", ROUTED))
def routed_rows(spark, sf):
    return R.routed_rows(stages.tagged(spark, sf)).select(
        "acct", "table_name", "sl_no", "row_seq", "party_group", "category_label"
    )


@query("sunday_rows", with_ctes("SELECT acct, row_seq, amount FROM tagged WHERE isodow(txn_date) = 7"))
def sunday_rows(spark, sf):
    return stages.tagged(spark, sf).filter(F.weekday("txn_date") == 6).select("acct", "row_seq", "amount")


@query("category_totals", with_ctes("""
SELECT acct, category, n, net, row_number() OVER (PARTITION BY acct ORDER BY abs(net) DESC, category) AS rk
FROM (SELECT acct, category, count(*) AS n, CAST(sum(amount) AS BIGINT) AS net FROM tagged GROUP BY 1, 2)"""))
def category_totals(spark, sf):
    return R.category_totals(stages.tagged(spark, sf)).withColumn("rk", F.col("rk").cast("bigint"))


GROUPS = {
    "Supplier / Vendor Settlements": "Operating Expenses (OpEx)", "Reversals & refunds": "Contra / Technical",
    "Cash Withdrawals": "Cash & Non-Operating", "Loan EMIs": "Debt Obligations (Fixed)",
    "Payroll & Wages": "Operating Expenses (OpEx)", "Bank Penalties & Non-Maintenance": "Banking Friction & Penal",
    "OD / CC Interest & Renewal Fees": "Debt Obligations (Fixed)", "GST Payments": "Statutory & Compliance",
    "Gambling / Betting / Real-Money Gaming": "Speculative & High-Risk Spending", "Loan Disbursal": "Capital & Financing",
    "Direct Cash Deposits": "Transfers & Adjustments", "Interest & Treasury Income": "Non-Operating Receipts",
    "Business income": "Operational Revenue",
}
GROUP_SQL = "CASE sub_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items()) + " ELSE '' END"


@query("category_mix", with_ctes(f"""
SELECT acct, sub_category, arg_max(CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END, row_seq) AS direction, count(*) AS n,
  CAST(sum(abs(amount)) AS BIGINT) AS amount, {GROUP_SQL} AS sub_group
FROM tagged WHERE sub_category <> '' GROUP BY acct, sub_category"""))
def category_mix(spark, sf):
    return R.category_mix(stages.tagged(spark, sf))


@query("largest_rows", with_ctes("""
SELECT acct, direction, rk, row_seq, amount FROM (
  SELECT *, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS direction,
    row_number() OVER (PARTITION BY acct, amount > 0 ORDER BY abs(amount) DESC, row_seq) AS rk FROM tagged) WHERE rk <= 10"""))
def largest_rows(spark, sf):
    return R.largest_rows(stages.tagged(spark, sf)).select(
        "acct", "direction", F.col("rk").cast("bigint").alias("rk"), "row_seq", "amount"
    )


ACCOUNTING = lambda c: f"CASE WHEN {c} < 0 THEN '(' || format('{{:,.2f}}', abs({c}) / 100.0) || ')' ELSE format('{{:,.2f}}', abs({c}) / 100.0) END"
DETAIL = """CASE WHEN category IN ('EMI transaction') THEN 'EMI paid to ' || p WHEN category = 'ECS transaction' THEN 'ECS transfer to ' || p
  WHEN category = 'Loan amount disbursal' THEN 'Loan amount disbursed from ' || p WHEN category = 'cash deposit' THEN 'cash deposit by ' || p
  WHEN category = 'cash withdrawal' THEN 'cash withdrawal by ' || p WHEN category = 'Salary paid' THEN 'Salary paid to ' || p
  WHEN category = 'Regular credit' THEN 'transfer from ' || p WHEN category = 'Regular debit' THEN 'transfer to ' || p ELSE category END"""


@query("transactions_csv", with_ctes(f"""
SELECT row_seq AS sl_no, strftime(txn_date, '%d-%m-%Y') AS date, account_no AS account, bank, '' AS cheque_no, description,
  {ACCOUNTING('amount')} AS amount, CASE WHEN sub_category <> '' THEN sub_category ELSE category END AS category, category AS tag,
  {DETAIL} AS category_detail, p AS party, format('{{:,.2f}}', balance / 100.0) AS balance
FROM (SELECT *, CASE WHEN party = '' THEN 'unknown party' ELSE party END AS p FROM tagged)"""))
def transactions_csv(spark, sf):
    return R.csv_rows(stages.tagged(spark, sf))


@query("credit_sheet", with_ctes(f"""
SELECT acct, 7 AS pos, 'Total credits' AS label, {ACCOUNTING('c')} AS value FROM (SELECT acct, sum(credits) AS c FROM d GROUP BY acct)
UNION ALL SELECT acct, 8, 'Total debits', {ACCOUNTING('c')} FROM (SELECT acct, sum(debits) AS c FROM d GROUP BY acct)
UNION ALL SELECT acct, 9, 'Average balance', {ACCOUNTING('avg_balance')} FROM bal
UNION ALL SELECT acct, 11, 'Closing balance', {ACCOUNTING('closing_balance')} FROM bal
UNION ALL SELECT acct, 20, 'Turnover trend', turnover_trend FROM trend
UNION ALL SELECT acct, 22, 'Monthly surplus (net inflow)', {ACCOUNTING('c')} FROM (SELECT acct, CAST(round(CAST(sum(credits) - sum(debits) AS DOUBLE) / count(DISTINCT date_trunc('month', txn_date))) AS BIGINT) AS c FROM d GROUP BY acct)""", TREND))
def credit_sheet(spark, sf):
    """The money and trend lines of the sheet; the other lines repeat other queries."""
    sheet = R.credit_sheet(M.credit_summary(stages.tagged(spark, sf)))
    return sheet.filter(F.col("pos").isin(7, 8, 9, 11, 20, 22))


SHEET_SQL = {
    "money": lambda c: ACCOUNTING(c), "pct": lambda c: f"CAST({c} AS VARCHAR) || '%'", "int": lambda c: f"CAST({c} AS VARCHAR)",
    "num": lambda c: f"CAST({c} AS VARCHAR)", "text": lambda c: c,
}
#: Every metric of the sheet has a query and SQL of its own; the sheet's SQL lays them out.
SHEET_PARTS = ["account_totals", "balance_stats", "turnover_trend", "balance_stability", "party_concentration"]


@query("credit_sheet_all", "WITH " + ", ".join(f"{n} AS ({ORACLES[n]})" for n in SHEET_PARTS) + ", sheet AS (SELECT * FROM account_totals "
       + " ".join(f"LEFT JOIN {n} USING (acct)" for n in SHEET_PARTS[1:]) + ") "
       + " UNION ALL ".join(f"SELECT acct, {i} AS pos, '{label}' AS label, {SHEET_SQL[kind](name)} AS value FROM sheet"
                            for i, (name, label, kind) in enumerate(R.CREDIT_SHEET, 1)))
def credit_sheet_all(spark, sf):
    """Every line of the sheet."""
    return R.credit_sheet(M.credit_summary(stages.tagged(spark, sf)))


@query("facility", with_ctes("""
SELECT DISTINCT acct, file_idx, CASE acct % 5 WHEN 1 THEN 'Savings' WHEN 2 THEN 'Current' WHEN 3 THEN 'Overdraft / Cash Credit'
  WHEN 4 THEN 'Overdraft / Cash Credit' ELSE '' END AS facility FROM ledger"""))
def facility(spark, sf):
    return S.headers(stages.ledger(spark, sf)).select("acct", "file_idx", R.facility(F.col("layout")).alias("facility"))


@query("party_groups", with_ctes("SELECT acct, pkey, label FROM labels", DAILY))
def party_groups(spark, sf):
    return M.party_labels(stages.tagged(spark, sf))
