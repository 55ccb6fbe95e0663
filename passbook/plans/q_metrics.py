"""Credit-metric queries and their oracles."""

from pyspark.sql import functions as F

from passbook.operators import metrics as M
from passbook.operators import validate as V
from passbook.plans import (
    q_validate,  # noqa: F401  # its SQL is part of that of the reads
    stages,
)
from passbook.plans.oracle_base import TAGGED, with_ctes
from passbook.plans.registry import ORACLES, query

NON_TURNOVER = "('Loan amount disbursal','Salary credited','Interest received','Investment return credited','return / refund','Related party credit')"
BOUNCED = "('inward bounce penal charges','Outward Bounced Xns')"
PKEY = "substr(upper(regexp_replace(party, '[^A-Za-z0-9]', '', 'g')), 1, 12)"

DAILY = TAGGED + f""",
d AS (
  SELECT acct, txn_date, count(*) AS n, count(*) FILTER (amount > 0) AS n_in, count(*) FILTER (amount < 0) AS n_out,
    CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS credits,
    CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS debits,
    CAST(coalesce(sum(amount) FILTER (amount > 0 AND category NOT IN {NON_TURNOVER}), 0) AS BIGINT) AS turnover,
    CAST(coalesce(sum(abs(amount)) FILTER (category = 'cash deposit'), 0) AS BIGINT) AS cash_in,
    CAST(coalesce(sum(abs(amount)) FILTER (category IN ('EMI transaction', 'Interest / fee payments')), 0) AS BIGINT) AS emi_out,
    count(*) FILTER (category IN {BOUNCED}) AS bounces,
    CAST(coalesce(sum(abs(amount)) FILTER (category IN {BOUNCED} OR category = 'other penal charges'), 0) AS BIGINT) AS penal,
    CAST(coalesce(sum(abs(amount)) FILTER (category = 'Loan amount disbursal'), 0) AS BIGINT) AS disbursals,
    CAST(coalesce(sum(abs(amount)) FILTER (category = 'Related party credit'), 0) AS BIGINT) AS related_in,
    arg_max(balance, row_seq) AS closing
  FROM tagged GROUP BY acct, txn_date),
runs AS (
  SELECT acct, txn_date, closing,
         datediff('day', txn_date, coalesce(lead(txn_date) OVER (PARTITION BY acct ORDER BY txn_date), CAST(txn_date + 1 AS DATE))) AS days FROM d),
eod AS (SELECT acct, CAST(unnest(generate_series(txn_date, CAST(txn_date + CAST(days AS INTEGER) - 1 AS DATE), INTERVAL 1 DAY)) AS DATE) AS day, closing AS balance FROM runs),
mon AS (
  SELECT acct, CAST(date_trunc('month', txn_date) AS DATE) AS month, CAST(sum(credits) AS BIGINT) AS credits,
         CAST(sum(turnover) AS BIGINT) AS turnover, CAST(sum(debits) AS BIGINT) AS debits,
         CAST(sum(credits) - sum(debits) AS BIGINT) AS net
  FROM d GROUP BY 1, 2 HAVING sum(n_in) + sum(n_out) > 0),
labels AS (
  SELECT acct, {PKEY} AS pkey, trim(arg_min(party, (-length(party), row_seq))) AS label
  FROM tagged WHERE party <> '' GROUP BY 1, 2),
stats AS (
  SELECT acct, count(*) AS eod_days, CAST(round(CAST(sum(balance) AS DOUBLE) / count(*)) AS BIGINT) AS avg_balance,
         min(balance) AS min_balance, arg_max(balance, day) AS closing_balance FROM eod GROUP BY acct),
floors AS (SELECT *, CASE WHEN avg_balance > 0 THEN greatest(1000000, CAST(round(avg_balance / 10.0) AS BIGINT)) END AS low_threshold FROM stats),
low AS (
  SELECT e.acct, e.day, e.balance < f.low_threshold AS low,
         sum(CASE WHEN e.balance < f.low_threshold THEN 0 ELSE 1 END) OVER (PARTITION BY e.acct ORDER BY e.day) AS island
  FROM eod e JOIN floors f ON f.acct = e.acct),
streaks AS (SELECT acct, CAST(sum(s) AS BIGINT) AS low_days, max(s) AS streak FROM (SELECT acct, island, count(*) AS s FROM low WHERE low GROUP BY 1, 2) GROUP BY acct),
bal AS (
  SELECT f.acct, eod_days, avg_balance, min_balance, closing_balance, low_threshold,
    CASE WHEN low_threshold IS NOT NULL THEN round(1000.0 * coalesce(low_days, 0) / eod_days) / 10.0 END AS low_days_pct,
    coalesce(streak, 0) AS longest_low_streak
  FROM floors f LEFT JOIN streaks s ON s.acct = f.acct)"""


def days(spark, sf):
    return M.daily(stages.tagged(spark, sf))


@query("account_totals", with_ctes("""
SELECT acct, months, credits, debits, turnover, cash_in, emi_out, bounces, penal, disbursals, related_in,
  credits - debits AS net_cashflow,
  CAST(round(CAST(credits AS DOUBLE) / months) AS BIGINT) AS avg_monthly_credits,
  CAST(round(CAST(debits AS DOUBLE) / months) AS BIGINT) AS avg_monthly_debits,
  CAST(round(CAST(turnover AS DOUBLE) / months) AS BIGINT) AS avg_monthly_turnover,
  CAST(round(CAST(emi_out AS DOUBLE) / months) AS BIGINT) AS emi_out_monthly,
  CAST(round(CAST(credits - debits AS DOUBLE) / months) AS BIGINT) AS monthly_surplus,
  CASE WHEN credits <> 0 THEN round(1000.0 * turnover / credits) / 10.0 ELSE 0.0 END AS turnover_share_pct,
  CASE WHEN turnover <> 0 THEN round(1000.0 * cash_in / turnover) / 10.0 ELSE 0.0 END AS cash_intensity_pct,
  CASE WHEN credits <> 0 THEN round(1000.0 * related_in / credits) / 10.0 ELSE 0.0 END AS related_credit_pct,
  CASE WHEN emi_out <> 0 THEN round(100.0 * turnover / emi_out) / 100.0 END AS servicing_coverage
FROM (SELECT acct, count(DISTINCT date_trunc('month', txn_date)) AS months, CAST(sum(credits) AS BIGINT) AS credits,
  CAST(sum(debits) AS BIGINT) AS debits, CAST(sum(turnover) AS BIGINT) AS turnover, CAST(sum(cash_in) AS BIGINT) AS cash_in,
  CAST(sum(emi_out) AS BIGINT) AS emi_out, CAST(sum(bounces) AS BIGINT) AS bounces, CAST(sum(penal) AS BIGINT) AS penal,
  CAST(sum(disbursals) AS BIGINT) AS disbursals, CAST(sum(related_in) AS BIGINT) AS related_in FROM d GROUP BY acct)""", DAILY))
def account_totals(spark, sf):
    return M.account_totals(days(spark, sf))


@query("eod_series", with_ctes("SELECT acct, day, balance FROM eod", DAILY), ("day",))
def eod_series(spark, sf):
    return M.eod_series(days(spark, sf))


@query("balance_stats", with_ctes("SELECT * FROM bal", DAILY), ("low_threshold",))
def balance_stats(spark, sf):
    return M.balance_stats(days(spark, sf))


@query("monthly_flow", with_ctes("SELECT acct, month, credits, turnover, debits, net FROM mon", DAILY), ("month",))
def monthly_flow(spark, sf):
    return M.monthly_flow(days(spark, sf))


TREND = DAILY + """,
tm AS (SELECT acct, turnover, row_number() OVER (PARTITION BY acct ORDER BY month) AS rank, count(*) OVER (PARTITION BY acct) AS n FROM mon WHERE turnover > 0),
halves AS (SELECT acct, max(n) AS n, coalesce(sum(turnover) FILTER (rank <= n // 2), 0) AS f, coalesce(sum(turnover) FILTER (rank > n // 2), 0) AS s FROM tm GROUP BY acct),
am AS (SELECT acct, turnover, row_number() OVER (PARTITION BY acct ORDER BY month) AS pos, count(*) OVER (PARTITION BY acct) AS total FROM mon),
q AS (SELECT acct, max(total) AS total, coalesce(sum(turnover) FILTER (pos > total - 3), 0) AS last3, coalesce(sum(turnover) FILTER (pos <= total - 3), 0) AS prior FROM am GROUP BY acct),
trend AS (
  SELECT q.acct, CASE WHEN coalesce(n, 0) < 4 OR f <= 0 THEN 'flat' WHEN CAST(s - f AS DOUBLE) / f > 0.15 THEN 'rising'
    WHEN CAST(s - f AS DOUBLE) / f < -0.15 THEN 'declining' ELSE 'stable' END AS turnover_trend,
    CASE WHEN total >= 6 AND prior > 0 THEN round(1000.0 * (CAST(last3 AS DOUBLE) / 3.0 - CAST(prior AS DOUBLE) / (total - 3)) / (CAST(prior AS DOUBLE) / (total - 3))) / 10.0 END AS last_quarter_change_pct,
    CAST(round(CAST(last3 AS DOUBLE) / 3) AS BIGINT) AS last3_avg,
    CASE WHEN total > 3 THEN CAST(round(CAST(prior AS DOUBLE) / (total - 3)) AS BIGINT) END AS prior_avg
  FROM q LEFT JOIN halves h ON h.acct = q.acct)"""


@query("turnover_trend", with_ctes("SELECT * FROM trend", TREND), ("prior_avg",))
def turnover_trend(spark, sf):
    return M.turnover_trend(M.monthly_flow(days(spark, sf)))


@query("balance_stability", with_ctes("""
SELECT m.acct, CASE WHEN count(*) >= 2 AND max(avg_balance) > 0 AND avg(mean) > 0
  THEN round(stddev_pop(mean) / avg(mean), 2) END AS balance_stability_cv
FROM (SELECT acct, date_trunc('month', txn_date) AS month, CAST(sum(closing) AS DOUBLE) / count(*) AS mean FROM d GROUP BY 1, 2) m
JOIN stats s ON s.acct = m.acct GROUP BY m.acct""", DAILY))
def balance_stability(spark, sf):
    return M.balance_stability(days(spark, sf))


PARTY = DAILY + f""",
pc AS (SELECT acct, {PKEY} AS pkey, CAST(sum(amount) AS BIGINT) AS credits FROM tagged WHERE party <> '' AND amount > 0 GROUP BY 1, 2),
pr AS (SELECT pc.*, label, row_number() OVER (PARTITION BY pc.acct ORDER BY credits DESC, pc.pkey) AS rk FROM pc JOIN labels l ON l.acct = pc.acct AND l.pkey = pc.pkey),
tot AS (SELECT acct, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS total, min(txn_date) AS ps, max(txn_date) AS pe FROM tagged GROUP BY acct)"""


@query("party_concentration", with_ctes("""
SELECT t.acct, coalesce(max(cnt), 0) AS distinct_credit_parties,
  CASE WHEN max(total) <> 0 THEN round(1000.0 * coalesce(max(credits), 0) / max(total)) / 10.0 ELSE 0.0 END AS top_party_share_pct,
  CASE WHEN max(total) <> 0 THEN round(1000.0 * coalesce(sum(credits), 0) / max(total)) / 10.0 ELSE 0.0 END AS top3_party_share_pct,
  string_agg(label || ':' || credits, '; ' ORDER BY rk) AS top_credit_parties
FROM tot t LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY acct) AS cnt FROM pr) p ON p.acct = t.acct AND rk <= 3
GROUP BY t.acct""", PARTY))
def party_concentration(spark, sf):
    return M.concentration(stages.tagged(spark, sf))


EMIS = PARTY + f""",
em AS (SELECT acct, CASE WHEN party = '' THEN 'AMT' || CAST(CAST(round_even(-amount / 10000.0, 0) AS BIGINT) * 100 AS VARCHAR) ELSE {PKEY} END AS pkey,
         date_trunc('month', txn_date) AS month, -sum(amount) AS paid, min(txn_date) AS f, max(txn_date) AS l
       FROM tagged WHERE category = 'EMI transaction' AND amount < 0 GROUP BY 1, 2, 3),
eo AS (SELECT em.acct, em.pkey, CAST(round(median(paid)) AS BIGINT) AS monthly_amount, count(*) AS months_seen, min(f) AS first_seen,
         max(l) AS last_seen, CAST(sum(paid) AS BIGINT) AS total_paid FROM em GROUP BY 1, 2),
ob AS (SELECT eo.*, coalesce(label, '(unnamed)') AS party, ps, pe,
         row_number() OVER (PARTITION BY eo.acct ORDER BY monthly_amount DESC, coalesce(label, '(unnamed)')) AS rk
       FROM eo LEFT JOIN labels l ON l.acct = eo.acct AND l.pkey = eo.pkey JOIN tot t ON t.acct = eo.acct)"""


@query("emi_obligations", with_ctes("""
SELECT acct, rk, party, monthly_amount, months_seen, first_seen, last_seen, total_paid, last_seen >= pe - 45 AS active,
  last_seen >= pe - 45 AND first_seen >= pe - 90 AND ps < pe - 90 AS is_new
FROM ob WHERE rk <= 15""", EMIS), ("first_seen", "last_seen"))
def emi_obligations(spark, sf):
    return M.emi_obligations(stages.tagged(spark, sf))


@query("bounce_trend", with_ctes("""
SELECT d.acct, CAST(coalesce(sum(bounces) FILTER (txn_date >= pe - 89), 0) AS BIGINT) AS bounces_last_90d,
  CAST(coalesce(sum(bounces) FILTER (txn_date >= pe - 179 AND txn_date < pe - 89), 0) AS BIGINT) AS bounces_prior_90d
FROM d JOIN tot t ON t.acct = d.acct GROUP BY d.acct""", PARTY))
def bounce_trend(spark, sf):
    return M.bounce_trend(days(spark, sf))


@query("two_way_parties", with_ctes(f"""
, years AS (SELECT acct * 10000 + file_idx AS acct, row_seq, party, amount FROM tagged),
bars AS (SELECT acct, greatest(2500000.0, coalesce(sum(amount) FILTER (amount > 0), 0) * 0.01) AS bar FROM years GROUP BY acct),
shown AS (SELECT acct, {PKEY} AS pkey, trim(arg_min(party, (-length(party), row_seq))) AS label FROM years WHERE party <> '' GROUP BY 1, 2)
SELECT acct, rk, party, credits, debits FROM (
  SELECT x.acct, l.label AS party, credits, debits,
    row_number() OVER (PARTITION BY x.acct ORDER BY least(credits, debits) DESC, x.pkey) AS rk
  FROM (SELECT g.acct, {PKEY} AS pkey, max(bar) AS bar,
          CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS credits,
          CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS debits
        FROM years g JOIN bars t ON t.acct = g.acct WHERE party <> '' AND abs(amount) >= bar GROUP BY 1, 2) x
  JOIN shown l ON l.acct = x.acct AND l.pkey = x.pkey WHERE least(credits, debits) >= bar) WHERE rk <= 5""".replace("\n, years", "years", 1), TAGGED + ","))
def two_way_parties(spark, sf):
    """G15, each account and year on its own: over all years no single row reaches the bar."""
    rows = stages.tagged(spark, sf).withColumn("acct", F.col("acct") * 10_000 + F.col("file_idx"))
    return M.two_way_parties(rows)


@query("high_risk_spend", with_ctes("""
SELECT acct, 'Gambling / betting / real-money gaming' AS risk_group, count(*) AS n, CAST(-sum(amount) AS BIGINT) AS spent
FROM tagged WHERE amount < 0 AND contains(description, 'DREAM11') GROUP BY acct"""))
def high_risk_spend(spark, sf):
    return M.high_risk_spend(stages.tagged(spark, sf))


@query("account_health", with_ctes("""
SELECT b.acct, breaks, avg_balance, min_balance, closing_balance, low_days_pct, longest_low_streak
FROM bal b JOIN (
  SELECT acct, count(*) FILTER (abs(prev + CASE WHEN balance_inverted THEN -amount ELSE amount END - balance) > 1.1) AS breaks
  FROM (SELECT *, lag(balance) OVER (PARTITION BY acct ORDER BY row_seq) AS prev FROM tagged) GROUP BY acct) v ON v.acct = b.acct""", DAILY))
def account_health(spark, sf):
    """Flagship: reconciliation breaks, mean balance and low-balance streak per account."""
    ledger = stages.ledger(spark, sf)
    days = ledger.withColumn(M.POS, M.position()).groupBy("acct", "txn_date").agg(
        F.max_by("balance", M.POS).alias("closing")
    )
    stats = M.balance_stats(days)
    breaks = V.chain_breaks(ledger, ["acct"], "txn_date", ["row_seq"])
    per = breaks.groupBy("acct").agg(F.count_if("broken").alias("breaks"))
    return stats.join(per, "acct").select(
        "acct", "breaks", "avg_balance", "min_balance", "closing_balance", "low_days_pct", "longest_low_streak"
    )


#: Every metric that a message names has SQL of its own; the messages are laid over them.
READ_PARTS = ["account_totals", "balance_stats", "turnover_trend", "balance_stability", "bounce_trend", "party_concentration", "account_status"]
RUPEES = lambda c: f"printf('%.0f', {c} / 100.0)"
SAID = [
    ("status <> 'passed'", "'Balance does not reconcile on every row — treat totals as provisional until the source document is complete.'"),
    ("bounces > 0", "bounces || ' bounce/return event(s) in ' || months || ' month(s) — a cheque/mandate discipline signal.'"),
    ("bounces_last_90d >= 2 AND bounces_last_90d > bounces_prior_90d", "'Bounces are increasing: ' || bounces_last_90d || ' in the last 90 days vs ' || bounces_prior_90d || ' in the 90 days before — recent cheque/mandate failures, not old history.'"),
    ("cash_intensity_pct >= 40", "'Cash-intensive: ' || cash_intensity_pct || '% of turnover is cash deposits — turnover is harder to verify independently.'"),
    ("avg_balance < 0", "'Average balance is negative — an overdraft / CC account operating in the drawn range.'"),
    ("emi_out > 0 AND emi_out_monthly > avg_monthly_turnover * 0.5", f"'EMI/interest outflow (~' || {RUPEES('emi_out_monthly')} || '/mo) is a large share of monthly turnover — limited headroom for new EMI.'"),
    ("n_active > 0", f"n_active || ' EMI obligation(s) active at period end (~' || {RUPEES('active_total')} || '/mo combined)' || CASE WHEN n_new > 0 THEN ', ' || n_new || ' added in the last quarter.' ELSE '.' END"),
    ("top_party_share_pct > 40", "CASE WHEN top_party_share_pct >= 50 THEN 'Credit concentration: the top counterparty is ' || top_party_share_pct || '% of all credits — revenue depends heavily on one source.' ELSE 'Credit concentration: the top counterparty is ' || top_party_share_pct || '% of all credits (top 3: ' || top3_party_share_pct || '%) — revenue leans on one customer.' END"),
    ("related_credit_pct >= 25", "related_credit_pct || '% of credits are from related parties — may overstate genuine third-party turnover.'"),
    ("turnover_trend IN ('declining', 'rising')", "CASE turnover_trend WHEN 'declining' THEN 'Turnover is declining over the period — business credits in the later months are materially below the earlier ones.' ELSE 'Turnover is rising over the period — a positive trend.' END"),
    ("last_quarter_change_pct <= -30", f"'Turnover in the last quarter averages ' || {RUPEES('last3_avg')} || '/mo vs ' || {RUPEES('CAST(prior_avg AS BIGINT)')} || '/mo earlier — down ' || -last_quarter_change_pct || '%.'"),
    ("balance_stability_cv > 0.6", "'Balance swings widely month to month — low liquidity stability, worth probing before relying on the average.'"),
    ("low_days_pct >= 25", f"'Balance sits below ' || {RUPEES('CAST(low_threshold AS BIGINT)')} || ' on ' || low_days_pct || '% of days (longest continuous stretch: ' || longest_low_streak || ' day(s)) — a thin liquidity buffer.'"),
    ("servicing_coverage < 1.5", "'Debt-service coverage is tight (inflow is ~' || servicing_coverage || '× existing EMI outflow) — little room for additional debt.'"),
    ("spent > 0", f"'Speculative / high-risk spending seen: ' || lower(risk_group) || ' (' || n_risk || ' txn, ' || {RUPEES('spent')} || ') — diversion of working capital, verify with the borrower.'"),
]
OBLIGED = with_ctes("""
SELECT acct, count(*) FILTER (last_seen >= pe - 45) AS n_active, count(*) FILTER (last_seen >= pe - 45 AND first_seen >= pe - 90 AND ps < pe - 90) AS n_new,
  CAST(coalesce(sum(monthly_amount) FILTER (last_seen >= pe - 45), 0) AS BIGINT) AS active_total FROM ob GROUP BY acct""", EMIS)


def reads_sql() -> str:
    """The messages of each account in order. No account of the given tables has a two-way party
    over its whole period (see ``two_way_parties``), so that message is left to the tests."""
    parts = ", ".join(f"{n} AS ({ORACLES[n]})" for n in READ_PARTS)
    joins = " ".join(f"LEFT JOIN {n} USING (acct)" for n in READ_PARTS[1:])
    joined = (
        f"WITH {parts}, obliged AS ({OBLIGED}), risky AS (SELECT acct, risk_group, n AS n_risk, spent FROM ({ORACLES['high_risk_spend']})), "
        f"whole AS (SELECT * FROM account_totals {joins} LEFT JOIN obliged USING (acct) LEFT JOIN risky USING (acct))"
    )
    said = ", ".join(f"CASE WHEN {when} THEN {what} END" for when, what in SAID)
    none = "'No adverse signals detected on the deterministic checks.'"
    return (
        f"{joined} SELECT acct, CAST(unnest(range(len(said))) AS INTEGER) AS pos, unnest(said) AS message FROM (SELECT acct, CASE WHEN len(x) > 0 THEN x ELSE [{none}] END AS said "
        f"FROM (SELECT acct, list_filter([{said}], lambda m: m IS NOT NULL) AS x FROM whole))"
    )


@query("credit_reads", reads_sql())
def credit_reads(spark, sf):
    df = stages.tagged(spark, sf)
    status = V.account_status(V.file_issues(V.with_file(df)), V.with_file(df))
    out = M.reads(M.credit_summary(df).join(status.select("acct", "status"), "acct"))
    return out.select("acct", F.posexplode("reads").alias("pos", "message"))
