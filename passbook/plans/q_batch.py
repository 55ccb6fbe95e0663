"""Tables over many statements and jobs, and sinks read back."""

from pyspark.sql import functions as F

from passbook.functions.category import category_detail
from passbook.operators import batch as B
from passbook.operators import reports as R
from passbook.operators import validate as V
from passbook.operators.categorise import categorise
from passbook.plans import stages
from passbook.plans.oracle_base import LEDGER, TAGGED, with_ctes
from passbook.plans.q_party import KIND
from passbook.plans.q_streaming import fresh
from passbook.plans.q_validate import STATUS
from passbook.plans.registry import query
from passbook.sources import publish as P
from passbook.sources import statements as S

PERIODS = LEDGER + """,
ranges AS (
  SELECT acct, CAST(date_trunc('month', txn_date) AS DATE) AS lo, CAST(date_trunc('month', txn_date) + CASE WHEN acct % 2 = 0 THEN INTERVAL 1 MONTH - INTERVAL 1 DAY ELSE INTERVAL 40 DAY END AS DATE) AS hi
  FROM ledger WHERE (acct * 7 + month(txn_date) + year(txn_date)) % 5 <> 0 GROUP BY ALL),
marked AS (SELECT *, CASE WHEN datediff('day', max(hi) OVER (PARTITION BY acct ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) <= 1 THEN 0 ELSE 1 END AS new FROM ranges),
islands AS (SELECT *, sum(new) OVER (PARTITION BY acct ORDER BY lo) AS period FROM marked)"""
SHORT = "CASE acct % 4 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'ICICI' WHEN 2 THEN 'AXIS' ELSE 'SBI' END"
MASK = "repeat('X', length(account_no) - 4) || right(account_no, 4)"
ROLLUP = STATUS + f""",
heads AS (SELECT acct, file_idx, max(page) AS n_pages, CASE WHEN file_idx % 4 = 0 AND acct % 3 = 0 THEN 2 ELSE 0 END AS bad FROM ledger GROUP BY 1, 2),
sums AS (SELECT acct, CAST(sum(n_pages) AS BIGINT) AS pages, count(*) AS files, CAST(sum(bad) AS BIGINT) AS unreadable_pages FROM heads GROUP BY acct),
rolled AS (
  SELECT l.acct, any_value(job_id) AS job_id, any_value(lower(replace(bank, ' ', '-')) || '-' || lower({MASK})) AS slug, any_value(bank) AS bank, any_value({MASK}) AS account_no,
    'M/S. HOLDER ' || l.acct || ' PRIVATE LIMITED' AS holder, any_value('M/S. HOLDER ' || l.acct || ' PRIVATE LIMITED - ' || {SHORT.replace('acct', 'l.acct')} || ' - ' || {MASK}) AS title,
    count(*) AS rows, any_value(pages) AS pages, any_value(files) AS files, any_value(unreadable_pages) AS unreadable_pages, any_value(status) AS validation, any_value(issues) AS issues
  FROM ledger l JOIN sums ON sums.acct = l.acct JOIN acct_status a ON a.acct = l.acct GROUP BY l.acct),
lost AS (SELECT job_id, count(*) AS failed_files FROM (SELECT DISTINCT job_id, acct, file_idx FROM ledger WHERE acct % 11 = 7 AND file_idx % 2 = 0) GROUP BY 1)"""
LABEL = "CASE WHEN sub_category <> '' THEN sub_category ELSE category END"
CONFIDENCE = "CASE WHEN category_source = 'recurrence-cadence' THEN 'medium' WHEN category_source <> 'fallback' THEN 'high' WHEN party0 <> '' THEN 'medium' ELSE 'low' END"
LAYOUT = "CASE acct % 5 WHEN 0 THEN 'plain_account_statement' WHEN 1 THEN 'plain_savings_statement' WHEN 2 THEN 'plain_current_statement' WHEN 3 THEN 'plain_od_statement' ELSE 'plain_cash_credit' END"
PROFILED = TAGGED + STATUS.removeprefix(LEDGER) + f""",
laid AS (SELECT *, {LAYOUT} AS layout, {KIND} AS kind, {LABEL} AS label FROM tagged),
half AS (SELECT * FROM laid WHERE file_idx % 2 = 0 AND acct % 5 <> 3),
facts AS (
  SELECT s.side, s.layout, count(*) AS rows, round(1000.0 * count(*) FILTER (kind = 'named') / count(*)) / 10.0 AS party_named_pct,
    round(1000.0 * count(*) FILTER (kind IN ('named', 'handle')) / greatest(count(*) FILTER (kind <> 'na'), 1)) / 10.0 AS party_nameable_pct,
    round(10.0 * sum(length(description)) / count(*)) / 10.0 AS mean_desc_len
  FROM (SELECT 'all' AS side, * EXCLUDE (side) FROM laid UNION ALL SELECT 'half', * EXCLUDE (side) FROM half) s GROUP BY 1, 2),
checked AS (
  SELECT side, layout, count(*) AS files, count(*) FILTER (status <> 'passed') AS not_reconciling FROM (
    SELECT 'all' AS side, {LAYOUT} AS layout, status FROM status UNION ALL SELECT 'half', {LAYOUT}, status FROM status WHERE file_idx % 2 = 0 AND acct % 5 <> 3) GROUP BY 1, 2),
mix AS (
  SELECT side, layout, label, n, round(1000.0 * n / rows) / 10.0 AS pct, row_number() OVER (PARTITION BY side, layout ORDER BY n DESC, encode(label)) AS k FROM (
    SELECT s.side, s.layout, label, count(*) AS n FROM (SELECT 'all' AS side, layout, label FROM laid UNION ALL SELECT 'half', layout, label FROM half) s GROUP BY 1, 2, 3)
  JOIN facts USING (side, layout)),
profile AS (SELECT f.*, files, not_reconciling FROM facts f JOIN checked c USING (side, layout))"""
FIGURES = " UNION ALL ".join(f"SELECT side, layout, '{m}' AS metric, CAST(NULL AS VARCHAR) AS category, CAST({m} AS DOUBLE) AS value FROM profile" for m in B.DRIFT)
JOBS = """
jobs AS (
  SELECT acct AS job_id, acct % 3 AS owner, (['awaiting_upload', 'processing', 'merging', 'done', 'failed', 'needs_review'])[acct % 6 + 1] AS status,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(acct AS INTEGER)) AS created_at, CASE WHEN acct % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(acct + acct % 90 AS INTEGER)) END AS updated_at
  FROM (SELECT DISTINCT acct FROM ledger))"""
NOW = "2024-01-01 02:00:00"


def headers(spark, sf):
    return stages.staged(spark, sf, "headers", lambda: S.headers(stages.ledger(spark, sf)))


def status(spark, sf):
    df = V.with_file(stages.ledger(spark, sf))
    return V.statement_status(V.file_issues(df), df)


def account_status(spark, sf):
    df = V.with_file(stages.ledger(spark, sf))
    return V.account_status(V.file_issues(df), df).select("acct", "issues", "status")


def failed(spark, sf):
    """Some files of some jobs, with what went wrong."""
    rows = headers(spark, sf).where("acct % 11 = 7 AND file_idx % 2 = 0")
    why = F.when(F.col("file_idx") % 4 == 0, "No layout for this bank").otherwise("not a readable file")
    return rows.select(
        "job_id", "acct", F.col("file_idx").alias("idx"), "source_file", why.alias("error"),
        (F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(days=(F.col("acct") % 40).cast("int"))).alias("created_at"),
    )


@query("period_islands", with_ctes("SELECT acct, period, min(lo) AS period_from, max(hi) AS period_to FROM islands GROUP BY 1, 2", PERIODS), ("period_from", "period_to", "period"))
def period_islands(spark, sf):
    """Months of account activity, some left out, some running over."""
    month = F.trunc("txn_date", "month")
    rows = stages.ledger(spark, sf).where((F.col("acct") * 7 + F.month("txn_date") + F.year("txn_date")) % 5 != 0)
    end = F.when(F.col("acct") % 2 == 0, F.last_day("lo")).otherwise(F.date_add("lo", 40))
    return B.collapsed_periods(rows.select("acct", month.alias("lo")).distinct().withColumn("hi", end))


@query("usable_groups", with_ctes("""
SELECT job_id, bank, account_no, row_number() OVER (PARTITION BY job_id ORDER BY first) AS group_no, files FROM (
  SELECT job_id, bank, account_no, min(idx) AS first, array_to_string(list(account_no || '-' || file_idx ORDER BY idx), ',') AS files FROM (
    SELECT DISTINCT acct AS job_id, bank || CASE WHEN file_idx % 3 = 0 THEN ' B' ELSE '' END AS bank, account_no, file_idx, file_idx AS idx FROM ledger
    WHERE NOT (acct % 11 = 7 AND file_idx % 2 = 0)) GROUP BY 1, 2, 3)""", LEDGER))
def usable_groups(spark, sf):
    """The files of a job by account; a job here has two accounts."""
    bank = F.concat("bank", F.when(F.col("file_idx") % 3 == 0, " B").otherwise(""))
    files = headers(spark, sf).select(F.col("acct").alias("job_id"), bank.alias("bank"), "account_no", F.col("file_idx").alias("idx"), "source_file")
    gone = failed(spark, sf).select(F.col("acct").alias("job_id"), "idx")
    out = B.account_groups(B.usable_files(files, gone))
    return out.withColumn("files", F.array_join("files", ",")).withColumn("group_no", F.col("group_no").cast("bigint"))


@query("account_rollup", with_ctes("SELECT * FROM rolled", ROLLUP))
def account_rollup(spark, sf):
    """I3, I4, I5."""
    return B.account_rollup(stages.ledger(spark, sf), headers(spark, sf), account_status(spark, sf))


@query("account_maps", with_ctes(f"""
SELECT acct, 'categories' AS map, {LABEL} AS key, count(*) AS value FROM tagged GROUP BY ALL
UNION ALL SELECT acct, 'category_amounts', {LABEL}, CAST(sum(abs(amount)) AS BIGINT) FROM tagged GROUP BY ALL
UNION ALL SELECT acct, 'tags', category, count(*) FROM tagged GROUP BY ALL
UNION ALL SELECT acct, 'confidence', {CONFIDENCE}, count(*) FROM tagged GROUP BY ALL
UNION ALL SELECT acct, 'party_quality', {KIND}, count(*) FROM tagged WHERE {KIND} <> 'na' GROUP BY ALL"""))
def account_maps(spark, sf):
    """The maps of every account, entry by entry."""
    names = ["categories", "category_amounts", "tags", "confidence", "party_quality"]
    maps = B.account_maps(stages.tagged(spark, sf))

    def entries_of(name):
        entry = lambda e: F.struct(F.lit(name).alias("map"), e["key"].alias("key"), e["value"].alias("value"))
        return F.transform(F.map_entries(name), entry)

    entries = F.flatten(F.array(*map(entries_of, names)))
    return maps.select("acct", F.inline(entries))


@query("job_rollup", with_ctes("""
SELECT job_id, count(*) AS accounts, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(files) AS BIGINT) AS files, CAST(sum(issues) AS BIGINT) AS issues,
  coalesce(any_value(failed_files), 0) AS failed_files,
  CASE max(CASE validation WHEN 'failed' THEN 2 WHEN 'passed' THEN 0 ELSE 1 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'passed_with_warnings' ELSE 'passed' END AS validation,
  CASE WHEN bool_or(validation <> 'passed') OR coalesce(any_value(failed_files), 0) > 0 THEN 'needs_review' ELSE 'done' END AS status
FROM rolled LEFT JOIN lost USING (job_id) GROUP BY job_id""", ROLLUP))
def job_rollup(spark, sf):
    """I6."""
    accounts = B.account_rollup(stages.ledger(spark, sf), headers(spark, sf), account_status(spark, sf))
    return B.job_rollup(accounts, failed(spark, sf))


@query("extraction_cost", with_ctes("""
SELECT acct AS job_id, count(*) FILTER (ai) AS ai_files, CAST(coalesce(sum(n) FILTER (ai), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(n // 3) FILTER (ai), 0) AS BIGINT) AS tokens_out,
  CAST(coalesce(sum(n // 50 + 1) FILTER (ai), 0) AS BIGINT) AS calls,
  CASE WHEN count(*) FILTER (ai) > 0 AND count(*) FILTER (ai AND unknown) = 0 THEN CAST(sum(n * 7) FILTER (ai) AS BIGINT) END AS micro_usd
FROM (SELECT acct, file_idx, count(*) AS n, (acct + file_idx) % 4 = 0 AS ai, acct % 6 = 1 AND file_idx % 3 = 0 AS unknown FROM ledger GROUP BY 1, 2) GROUP BY acct""", LEDGER))
def extraction_cost(spark, sf):
    """Files read by a model, some at a price that is not known."""
    ai, n = (F.col("acct") + F.col("file_idx")) % 4 == 0, F.col("n_rows")
    unknown = (F.col("acct") % 6 == 1) & (F.col("file_idx") % 3 == 0)
    third = F.floor(n / 3).cast("bigint")
    return B.extraction_cost(headers(spark, sf).select(
        F.col("acct").alias("job_id"), F.when(ai, n).alias("tokens_in"), F.when(ai, third).alias("tokens_out"),
        F.when(ai, F.floor(n / 50).cast("bigint") + 1).alias("calls"), F.when(ai & ~unknown, n * 7).alias("micro_usd"),
    ))


def profile(spark, sf, half: bool = False):
    layout = headers(spark, sf).select("acct", "file_idx", "layout")
    some = F.lit(True) if not half else (F.col("file_idx") % 2 == 0) & (F.col("acct") % 5 != 3)
    rows = stages.tagged(spark, sf).where(some).join(layout, ["acct", "file_idx"])
    return B.corpus_profile(rows, status(spark, sf).where(some).join(layout, ["acct", "file_idx"]))


@query("corpus_profile", with_ctes("""
SELECT layout, files, CAST(0 AS BIGINT) AS unreadable_files, rows, not_reconciling, party_named_pct, party_nameable_pct, mean_desc_len,
  (SELECT string_agg(label || '=' || CAST(CAST(round(pct * 10) AS BIGINT) AS VARCHAR), ';' ORDER BY encode(label)) FROM mix m WHERE m.side = 'all' AND m.layout = p.layout AND k <= 6) AS top_categories
FROM profile p WHERE side = 'all'""", PROFILED))
def corpus_profile(spark, sf):
    """I8."""
    out = profile(spark, sf)
    pairs = F.transform(
        F.array_sort(F.map_entries("top_categories")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10).cast("bigint").cast("string"))
    )
    return out.withColumn("top_categories", F.array_join(pairs, ";"))


@query("corpus_drift", with_ctes(f"""
, figures AS ({FIGURES} UNION ALL SELECT side, layout, 'category', label, pct FROM mix WHERE k <= 6),
sides AS (SELECT layout, bool_or(side = 'all') AS a, bool_or(side = 'half') AS h FROM profile GROUP BY 1)
SELECT layout, 'missing' AS metric, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS after FROM sides WHERE a AND NOT h
UNION ALL SELECT layout, metric, category, b, n FROM (
  SELECT layout, metric, category, coalesce(max(value) FILTER (side = 'all'), 0.0) AS b, coalesce(max(value) FILTER (side = 'half'), 0.0) AS n FROM figures GROUP BY 1, 2, 3)
JOIN sides USING (layout) WHERE a AND h AND abs(n - b) > CASE metric WHEN 'rows' THEN 0 WHEN 'not_reconciling' THEN 0 WHEN 'party_named_pct' THEN 1 ELSE 3 END""".replace("\n, figures", "figures", 1), PROFILED + ","), ("before", "after", "category"))
def corpus_drift(spark, sf):
    """The whole corpus as stored, against every other year without one layout."""
    stored = fresh(spark, "profile")
    profile(spark, sf).write.parquet(stored)
    out = B.drift(spark.read.parquet(stored), profile(spark, sf, half=True))
    return out


@query("output_sweep", with_ctes("""
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN row_seq % 31 = 1 THEN 'party_is_channel_word' WHEN row_seq % 31 = 2 THEN 'party_too_short' WHEN row_seq % 31 = 3 THEN 'party_is_ifsc' WHEN row_seq % 31 = 4 THEN 'party_has_junk_chars' END AS kind FROM tagged
  UNION ALL SELECT CASE WHEN row_seq % 31 = 5 THEN 'empty_description' WHEN row_seq % 31 = 6 THEN 'footer_or_header_in_description' WHEN row_seq % 31 = 7 THEN 'control_chars_in_description' WHEN row_seq % 31 = 8 THEN 'two_transactions_merged' END FROM tagged
  UNION ALL SELECT CASE WHEN row_seq % 31 = 9 AND amount <> 0 THEN 'category_contradicts_sign' END FROM tagged
  UNION ALL SELECT CASE WHEN row_seq % 31 = 10 THEN 'emi_under_100' END FROM tagged
  UNION ALL SELECT CASE WHEN row_seq % 31 = 11 THEN 'detail_says_unknown_but_party_known' END FROM tagged) WHERE kind IS NOT NULL GROUP BY 1"""))
def output_sweep(spark, sf):
    """One defect of each kind planted in every 31 rows; what the rows had is made clean first."""
    k = F.col("row_seq") % 31
    party = F.when(k == 1, "Neft").when(k == 2, "Ab").when(k == 3, "HDFC0 001234").when(k == 4, "A/B/C").otherwise("Clean Name")
    text = F.when(k == 5, " ").when(k == 6, "Closing Balance 5").when(k == 7, "PAY\x01").when(k == 8, "UPI/DR/123456789 UPI/CR/987654321").otherwise("PAY")
    tag = F.when(k == 9, F.when(F.col("amount") > 0, "EMI transaction").otherwise("cash deposit")).when(k == 10, "EMI transaction").otherwise("ECS transaction")
    amount = F.when(k == 10, -F.lit(50)).when(k == 9, F.when(F.col("amount") > 0, F.col("amount") + 20_000).otherwise(F.col("amount"))).otherwise(F.col("amount"))
    rows = stages.tagged(spark, sf).withColumns({"party": party, "description": text, "category": tag, "amount": amount})
    detail = F.when(k == 11, "transfer to unknown party").otherwise(category_detail())
    return B.sweep_digest(B.sweep(rows, detail)).select("kind", "n")


@query("labelled_accuracy", with_ctes("""
SELECT category, count(*) AS n, count(*) AS hits FROM (
  SELECT DISTINCT description, amount, CASE WHEN amount < 0 THEN CASE slot WHEN 4 THEN 'Salary paid' WHEN 5 THEN 'Outward Bounced Xns' WHEN 6 THEN 'Interest / fee payments' WHEN 7 THEN 'other penal charges' WHEN 8 THEN 'EMI transaction' END
    ELSE CASE slot WHEN 4 THEN 'Loan amount disbursal' WHEN 5 THEN 'cash deposit' WHEN 6 THEN 'Interest received' WHEN 7 THEN 'Salary credited' WHEN 8 THEN 'return / refund' WHEN 10 THEN 'Regular credit' END END AS category
  FROM ledger) WHERE category IS NOT NULL GROUP BY 1""", LEDGER))
def labelled_accuracy(spark, sf):
    """Labelled narrations through a file, each read on its own, against their labels."""
    rows, slot = stages.ledger(spark, sf), F.col("slot")
    out = F.when(slot == 4, "Salary paid").when(slot == 5, "Outward Bounced Xns").when(slot == 6, "Interest / fee payments").when(slot == 7, "other penal charges").when(slot == 8, "EMI transaction")
    into = F.when(slot == 4, "Loan amount disbursal").when(slot == 5, "cash deposit").when(slot == 6, "Interest received").when(slot == 7, "Salary credited").when(slot == 8, "return / refund").when(slot == 10, "Regular credit")
    truth = rows.select("description", "amount", "bank", F.when(F.col("amount") < 0, out).otherwise(into).alias("new_category"))
    path = fresh(spark, "truth")
    P.export_corrections(truth.where("new_category IS NOT NULL").dropDuplicates(["description", "amount"]), path)
    known = stages.stage(P.read_truth(spark, path), "truth_rows")
    return B.accuracy(classified(known), known)


def classified(rows):
    """narrations on their own (``description``, ``amount``): mode, party, tag and detail."""
    bare = rows.select("description", "amount").distinct()
    lone = bare.select(
        "description", "amount", F.lit("").alias("side"), F.xxhash64("description", "amount").alias("acct"), F.lit(0).alias("file_idx"),
        F.lit(1).cast("long").alias("row_seq"), F.lit("2025-01-01").cast("date").alias("txn_date"), F.lit(0).cast("long").alias("balance"),
    )
    named = stages.stage(stages.row_parties(lone), "lone_narrations")
    party = F.coalesce(F.nullif("party", F.lit("")), F.lit("unknown party"))
    return categorise(named).select("description", "amount", "mode", party.alias("party"), "category", category_detail().alias("detail"))


@query("layout_queue", with_ctes("""
SELECT job_id, acct, file_idx AS idx, row_number() OVER (ORDER BY acct % 40 DESC, job_id, file_idx, acct) AS place FROM (
  SELECT DISTINCT acct AS job_id, acct, file_idx FROM ledger WHERE acct % 11 = 7 AND file_idx % 4 = 0)""", LEDGER))
def layout_queue(spark, sf):
    """I12."""
    return B.layout_queue(failed(spark, sf).withColumn("job_id", F.col("acct"))).select("job_id", "acct", "idx", "place")


def jobs(spark, sf):
    accts = stages.ledger(spark, sf).select("acct").distinct()
    at = lambda n: F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(mins=n.cast("int"))
    a = F.col("acct")
    names = F.array(*map(F.lit, ["awaiting_upload", "processing", "merging", "done", "failed", "needs_review"]))
    return accts.select(
        a.alias("job_id"), (a % 3).alias("owner"), F.get(names, (a % 6).cast("int")).alias("status"), at(a).alias("created_at"),
        F.when(a % 7 != 0, at(a + a % 90)).alias("updated_at"),
    )


@query("stale_jobs", with_ctes(f"""
, {JOBS.strip()}
SELECT job_id, status, idle // 60 AS idle_minutes FROM (SELECT *, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(coalesce(updated_at, created_at))::BIGINT AS idle FROM jobs)
WHERE status IN ('awaiting_upload', 'processing', 'merging') AND idle > CASE status WHEN 'awaiting_upload' THEN 3600 ELSE 1200 END""".replace("\n, jobs", "jobs", 1), LEDGER + ","))
def stale_jobs(spark, sf):
    """I13 at two in the morning."""
    return B.stale_jobs(jobs(spark, sf), F.expr(f"timestamp'{NOW}'")).select("job_id", "status", "idle_minutes")


@query("recent_jobs", with_ctes(f"""
, {JOBS.strip()}
SELECT owner, job_id, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, job_id) AS place FROM jobs) WHERE place <= 60""".replace("\n, jobs", "jobs", 1), LEDGER + ","))
def recent_jobs(spark, sf):
    """I14."""
    return B.recent_jobs(jobs(spark, sf)).select("owner", "job_id", F.col("place").cast("bigint").alias("place"))


@query("layout_samples", with_ctes(f"""
SELECT layout, path, place FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY encode(bank), size, encode(path)) AS place FROM (
  SELECT {LAYOUT} AS layout, bank, account_no || '-' || file_idx AS path, count(*) AS size FROM ledger GROUP BY ALL)) WHERE place <= 2""", LEDGER))
def layout_samples(spark, sf):
    """I15."""
    files = headers(spark, sf).select("layout", "bank", F.col("source_file").alias("path"), F.col("n_rows").alias("size"))
    return B.layout_samples(files).select("layout", "path", F.col("place").cast("bigint").alias("place"))


@query("party_floor", with_ctes("""
SELECT acct, file_idx, count(*) FILTER (should) AS nameable, count(*) FILTER (should AND party <> '' AND acct % 3 <> 0 AND acct % 4 <> 2) AS filled FROM (
  SELECT *, regexp_matches(description, 'UPI|NEFT|RTGS|IMPS|MMT|ACH|TRANSFER|TRF|INF[/-]', 'i') AND NOT regexp_matches(description, 'UPISETTLEMENT|\\bPOS\\b|ATW-|CHRGS|/GST/|CASH', 'i') AS should FROM tagged)
GROUP BY acct, file_idx HAVING count(*) FILTER (should) >= 25 AND count(*) FILTER (should AND party <> '' AND acct % 3 <> 0 AND acct % 4 <> 2) < 0.1 * count(*) FILTER (should) AND acct % 4 <> 2"""))
def party_floor(spark, sf):
    """I16: some accounts with their parties lost; one bank is a co-operative."""
    rows = stages.tagged(spark, sf)
    rows = rows.withColumn("party", F.when((F.col("acct") % 3 == 0) | (F.col("acct") % 4 == 2), "").otherwise(F.col("party")))
    rows = rows.withColumn("bank", F.when(F.col("acct") % 4 == 2, "Valley Co-operative Bank").otherwise(F.col("bank")))
    return B.party_floor(rows).select("acct", "file_idx", "nameable", "filled")


@query("report_tables", with_ctes("""
SELECT CASE category WHEN 'EMI transaction' THEN 'EMI Xns' WHEN 'ECS transaction' THEN 'ECS Xns' WHEN 'cash deposit' THEN 'Cash Deposit Xns' WHEN 'cash withdrawal' THEN 'Cash Withdrawal Xns'
    WHEN 'Salary paid' THEN 'Salary Paid Xns' WHEN 'Salary credited' THEN 'Salary Paid Xns' WHEN 'Loan amount disbursal' THEN 'Loan Disbursed Xns' WHEN 'inward bounce penal charges' THEN 'Bounced-Penal Xns'
    WHEN 'Outward Bounced Xns' THEN 'Outward Bounced Xns' WHEN 'other penal charges' THEN 'Bounced-Penal Xns' WHEN 'Regular credit' THEN 'Regular Credits' WHEN 'Regular debit' THEN 'Regular Debits' ELSE 'Other Xns' END AS report,
  job_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM tagged GROUP BY ALL
UNION ALL SELECT 'Xns', job_id, count(*), CAST(sum(amount) AS BIGINT) FROM tagged GROUP BY ALL
UNION ALL SELECT 'SundayXns', job_id, count(*), CAST(sum(amount) AS BIGINT) FROM tagged WHERE dayofweek(txn_date) = 0 GROUP BY ALL
UNION ALL SELECT 'Category Totals', job_id, count(*), CAST(sum(net) AS BIGINT) FROM (SELECT job_id, acct, category, sum(amount) AS net FROM tagged GROUP BY ALL) GROUP BY ALL"""))
def report_tables(spark, sf):
    """Named tables written twice (the second time for some jobs only), and read back by name."""
    root, tagged = fresh(spark, "reports"), stages.tagged(spark, sf)

    def publish(rows):
        totals = R.category_totals(rows).join(rows.select("acct", "job_id").distinct(), "acct")
        P.write_reports({"Category Totals": totals}, R.routed_rows(rows), root)

    publish(tagged)
    publish(stages.stage(tagged.where("job_id IN (1, 4)"), "again"))
    rows = spark.read.parquet(f"{root}/rows").groupBy("table_name", F.col("job_id").cast("int").alias("job_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")
    )
    totals = P.read_report(spark, root, "Category Totals").groupBy(F.col("job_id").cast("int").alias("job_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("net").alias("total")
    )
    return rows.withColumnRenamed("table_name", "report").unionByName(totals.withColumn("report", F.lit("Category Totals")))


@query("corrections", with_ctes("""
SELECT CAST(job_id AS BIGINT) AS job_id, place, CASE WHEN description = '' THEN 'description required' WHEN row_seq % 6 = 0 THEN 'a corrected category, party or note is required'
  WHEN row_number() OVER (PARTITION BY job_id, description <> '' AND row_seq % 6 <> 0 ORDER BY place) > 50 THEN 'correction limit reached' END AS refused FROM (
  SELECT job_id, row_seq, acct * 1000000 + row_seq AS place, CASE WHEN row_seq % 7 = 0 THEN '' ELSE trim(description) END AS description FROM ledger WHERE row_seq % 10 = 2)""", LEDGER), ("refused",))
def corrections(spark, sf):
    """Corrections in two batches, the first written twice; fifty a job are taken."""
    root, rows = fresh(spark, "corrections"), stages.ledger(spark, sf).where("row_seq % 10 = 2")
    given = rows.select(
        F.col("job_id").cast("long").alias("job_id"), *(F.lit(None).cast("string").alias(n) for n in P.WIDTHS if n not in ("description", "new_category", "note")),
        F.when(F.col("row_seq") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "description")).alias("description"),
        F.when(F.col("row_seq") % 6 == 2, " Regular credit ").alias("new_category"), F.when(F.col("row_seq") % 6 == 4, "look").alias("note"),
        "amount", (F.col("acct") * 1_000_000 + F.col("row_seq")).alias("place"),
    )
    middle = given.agg(F.expr("percentile_approx(place, 0.5)")).first()[0] or 0
    early, late = given.where(F.col("place") <= middle), given.where(F.col("place") > middle)
    done = [P.append_corrections(part, root, k, 50) for k, part in ((0, early), (0, early), (1, late))]
    return done[1].unionByName(done[2]).select("job_id", "place", "refused")


@query("json_report", with_ctes("""
SELECT acct, count(*) AS rows, CAST(sum(amount) AS BIGINT) AS total, any_value(a.status) AS status, any_value(bank) AS bank, max(row_seq) AS last_row, 1 + (count(*) - 1) // 200 AS parts
FROM ledger JOIN acct_status a USING (acct) GROUP BY acct""", STATUS))
def json_report(spark, sf):
    """Accounts with header, validation and rows, read back."""
    root, rows = fresh(spark, "json"), stages.ledger(spark, sf)
    meta = headers(spark, sf).groupBy("acct").agg(F.first("bank").alias("bank"), F.first("account_no").alias("account_no"))
    P.write_json(rows, meta, account_status(spark, sf), root, 200)
    back = spark.read.json(root).select("acct", "part", "meta.bank", "validation.status", F.explode("transactions").alias("t"))
    return back.groupBy("acct").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("t.amount").alias("total"), F.max("status").alias("status"), F.max("bank").alias("bank"),
        F.max_by("t.row_seq", "t.sl_no").alias("last_row"), F.count_distinct("part").alias("parts"),
    )


@query("csv_export", with_ctes(f"""
SELECT any_value(lower(replace(bank, ' ', '-')) || '-' || account_no) AS slug, count(*) AS rows, max(row_seq) AS last_no, count(*) FILTER (amount < 0) AS bracketed,
  count(DISTINCT {LABEL}) AS categories FROM tagged GROUP BY acct"""))
def csv_export(spark, sf):
    """One folder of printed rows per account, read back."""
    root, rows = fresh(spark, "csv"), stages.tagged(spark, sf)
    P.write_csv(rows, root, B.slug(F.col("bank"), F.col("account_no")))
    return P.read_csv(spark, root).groupBy("slug").agg(
        F.count(F.lit(1)).alias("rows"), F.max("sl_no").alias("last_no"), F.count_if(F.col("amount").startswith("(")).alias("bracketed"),
        F.count_distinct("category").alias("categories"),
    )


@query("account_files", with_ctes("""
SELECT acct, least(150, n) AS shown, n AS total, first_text, coalesce(listed, 0) AS issues, files_listed FROM (
  SELECT acct, count(*) AS n, arg_min(description, row_seq) AS first_text FROM ledger GROUP BY acct)
LEFT JOIN (SELECT acct, count(*) AS listed FROM issues GROUP BY acct) USING (acct)
LEFT JOIN (SELECT acct, count(*) FILTER (bad OR broken) AS files_listed FROM (
  SELECT f.acct, f.file_idx, f.file_idx % 4 = 0 AND f.acct % 3 = 0 AS bad, coalesce(i.n, 0) > 0 AS broken FROM (SELECT DISTINCT acct, file_idx FROM ledger) f
  LEFT JOIN (SELECT acct, file_idx, count(*) AS n FROM issues GROUP BY 1, 2) i ON i.acct = f.acct AND i.file_idx = f.file_idx) GROUP BY acct) USING (acct)""", STATUS))
def account_files(spark, sf):
    """Previews and issue lists, read back."""
    previews, lists, rows = fresh(spark, "previews"), fresh(spark, "issues"), stages.tagged(spark, sf)
    P.write_previews(rows, previews)
    df = V.with_file(stages.ledger(spark, sf))
    statements = headers(spark, sf).select("acct", "file_idx", "source_file", "unreadable_pages").join(status(spark, sf).select("acct", "file_idx", "status"), ["acct", "file_idx"])
    P.write_issues(V.file_issues(df), statements, account_status(spark, sf), lists, 3)
    shown = spark.read.json(previews).select("acct", F.size("rows").cast("bigint").alias("shown"), "total", F.get("rows", 0)["description"].alias("first_text"))
    listed = spark.read.json(lists)
    each = listed.select("acct", F.explode_outer("statements").alias("s")).groupBy("acct").agg(
        F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.size("s.issues"))), F.lit(0)).cast("bigint").alias("issues"),
        F.count_distinct("s.file_idx").alias("files_listed"),
    )
    return shown.join(each, "acct")


@query("vocabulary_rows", with_ctes("""
SELECT acct, count(*) AS n FROM ledger WHERE regexp_matches(upper(description), '\\b(UPI|IMPS|NEFT|RTGS|ACH)\\b') GROUP BY acct""", LEDGER))
def vocabulary_rows(spark, sf):
    """A3, A4: word lists loaded as rows; here the rows whose words are among some channel stamps."""
    words = P.load_keywords(spark).where("list = 'NARRATION_STAMPS' AND keyword IN ('UPI', 'IMPS', 'NEFT', 'RTGS', 'ACH')")
    tokens = F.array_distinct(F.regexp_extract_all(F.upper("description"), F.lit(r"\b([A-Z]+)\b"), F.lit(1)))
    rows = stages.ledger(spark, sf).select("acct", "file_idx", "row_seq", F.explode(tokens).alias("keyword"))
    hits = rows.join(words, "keyword", "left_semi").select("acct", "file_idx", "row_seq").distinct()
    return hits.groupBy("acct").agg(F.count(F.lit(1)).alias("n"))
