"""DuckDB SQL for the derived ledger; every oracle query starts from these CTEs."""

POSTINGS = """
rows0 AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_linestatus, CAST(l_shipdate AS DATE) AS txn_date,
         CAST(l_partkey % 12 AS INTEGER) AS slot, l_linestatus = 'F' AS is_debit,
         upper(p_name) || ' TRADERS' AS nm, upper(split_part(p_name, ' ', 2)) AS noun,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS ref,
         translate(substr(md5(p_name), 1, 12), 'abcdef', '012345') AS ident,
         l_linenumber % 2 = 1 AS named
  FROM lineitem JOIN part ON l_partkey = p_partkey),
rows1 AS (
  SELECT *, CAST(CASE
    WHEN is_debit AND slot = 2 THEN 1500000 + l_suppkey * 100
    WHEN slot = 3 THEN 1000000 + 500000 * ((l_partkey // 12) % 2)
    WHEN is_debit AND slot = 5 THEN 59000
    WHEN is_debit AND slot = 7 THEN 17700
    WHEN is_debit AND slot = 8 THEN 2174300 + l_suppkey * 100
    ELSE round(l_extendedprice * 100) END AS BIGINT) AS paise,
    CASE WHEN is_debit THEN CASE slot
      WHEN 0 THEN 'UPI/' || ref || '/DR/' || nm || '/HDFC/'
      WHEN 1 THEN 'NEFT/' || ref || '/' || nm || '/HDFC BANK/'
      WHEN 2 THEN 'ACH/' || noun || ' CORP/' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || '/'
      WHEN 3 THEN 'ATW-416021XXXXXX' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || '-P3ENTV02-HYDERABAD'
      WHEN 4 THEN 'IMPS/P2A/' || ref || '/' || nm || '/KKBK/salary'
      WHEN 5 THEN 'Chq Rtrn Chrgs Incl GST ' || ref
      WHEN 6 THEN 'Int.Pd:' || ref
      WHEN 7 THEN 'MIN BAL CHG ' || ref
      WHEN 8 THEN 'UPI-BAJAJ FINANCE-bajajfin@icici-' || ref
      WHEN 9 THEN 'UPI/' || ref || '/DR/DREAM11 GAMES/YESB/'
      WHEN 10 THEN 'GST PMT CPIN ' || ref
      ELSE 'TRANSFER TO ' || ident || CASE WHEN named THEN ' ' || nm ELSE '' END END
    ELSE CASE slot
      WHEN 0 THEN 'UPI/' || ref || '/CR/' || nm || '/HDFC/'
      WHEN 1 THEN 'NEFT Cr-ICIC0SF0002-' || nm || '-' || ref
      WHEN 2 THEN 'ACH-CR-' || nm || '-NACH-' || ref
      WHEN 3 THEN 'ATW-416021XXXXXX' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || '-P3ENTV02-HYDERABAD'
      WHEN 4 THEN 'NEFT-HDFCN' || ref || '-TATA CAPITAL LIMITED-'
      WHEN 5 THEN 'BY CASH-MAIN BRANCH'
      WHEN 6 THEN 'Int.Pd:' || ref
      WHEN 7 THEN 'IMPS/P2A/' || ref || '/' || nm || '/KKBK/salary'
      WHEN 8 THEN 'REV-UPI-' || ref || '-' || lower(noun) || 'store@YBL-UPI'
      WHEN 9 THEN 'UPI-' || ref || '-98' || lpad(CAST(l_suppkey % 100000000 AS VARCHAR), 8, '0') || '@PTYES-IDIB000S063-PAYMENT'
      WHEN 10 THEN 'RTGS/UTIBR5' || ref || '/' || nm || '/AXIS BANK'
      ELSE 'BY TRANSFER FROM ' || ident || CASE WHEN named THEN ' ' || nm ELSE '' END END END AS description
  FROM rows0),
standing AS (
  SELECT l_suppkey, month, year(month) * 12 + month(month) AS mi
  FROM (SELECT DISTINCT l_suppkey, CAST(date_trunc('month', txn_date) AS DATE) AS month FROM rows0)),
postings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_linestatus, l_suppkey,
         txn_date, slot, CASE WHEN is_debit THEN -paise ELSE paise END AS amount, description,
         CASE WHEN is_debit OR slot = 3 THEN 'debit' ELSE 'credit' END AS side, nm, noun, ident, named
  FROM rows1
  UNION ALL
  SELECT 0, 0, 0, 0.0, 0.0, 'F', l_suppkey,
         CAST(month + CAST(5 + CASE WHEN l_suppkey % 10 = 3 THEN mi % 10 ELSE (l_suppkey + mi) % 3 END AS INTEGER) AS DATE),
         12, -(3123700 + l_suppkey * 100), 'IMPS/P2A/' || strftime(month, '%Y%m') || '000000/MERIDIAN HOLDINGS/KKBK/',
         'debit', 'MERIDIAN HOLDINGS', '', '', true
  FROM standing)"""

LEDGER = (
    POSTINGS
    + """,
numbered AS (
  SELECT *, row_number() OVER w AS row_seq,
         sum(amount) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM postings
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY txn_date, l_orderkey, l_linenumber, l_partkey,
               l_extendedprice, l_quantity, l_linestatus)),
ledger AS (
  SELECT CAST(l_suppkey % 10 AS INTEGER) AS job_id,
         CASE l_suppkey % 4 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'ICICI Bank' WHEN 2 THEN 'Axis Bank'
              ELSE 'State Bank of India' END AS bank,
         '50100' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS account_no, l_suppkey AS acct,
         CAST(year(txn_date) AS INTEGER) AS file_idx, row_seq, txn_date, slot, description,
         CAST(amount AS BIGINT) AS amount,
         CAST(50000000 + CASE WHEN l_suppkey % 9 = 4 THEN -run ELSE run END
              + CASE WHEN l_orderkey % 500 = 0 AND slot < 12 THEN 10000 ELSE 0 END AS BIGINT) AS balance,
         side, l_suppkey % 9 = 4 AS balance_inverted,
         CAST((row_seq - 1) // 40 + 1 AS INTEGER) AS page, nm, noun, ident, named
  FROM numbered)"""
)

# What each narration shape must resolve to, stated per slot instead of re-running rules.
TAGGED = (
    LEDGER
    + """,
truth0 AS (
  SELECT *,
    CASE WHEN slot = 12 THEN nm
         WHEN amount < 0 THEN CASE WHEN slot IN (0, 1, 4) THEN nm WHEN slot = 2 THEN noun || ' CORP'
              WHEN slot = 8 THEN 'BAJAJ FINANCE' WHEN slot = 9 THEN 'DREAM11 GAMES'
              WHEN slot = 11 AND named THEN nm ELSE '' END
         ELSE CASE WHEN slot IN (0, 1, 2, 7, 10) THEN nm WHEN slot = 4 THEN 'TATA CAPITAL LIMITED'
              WHEN slot = 8 THEN 'Reversals & refunds'
              WHEN slot = 9 THEN '98' || lpad(CAST(acct % 100000000 AS VARCHAR), 8, '0') || '@PTYES'
              WHEN slot = 11 AND named THEN nm ELSE '' END END AS party0,
    year(txn_date) * 12 + month(txn_date) AS mi
  FROM ledger),
series AS (
  SELECT acct, replace(upper(party0), ' ', '') AS solid, amount,
         count(DISTINCT CASE WHEN slot = 2 THEN mi END) >= 3 AS rec_nach,
         amount <= -50000 AND length(replace(upper(party0), ' ', '')) >= 4 AND count(DISTINCT mi) >= 3
           AND count(*) <= count(DISTINCT mi) + 1 AND amount % 50000 <> 0
           AND max(mi) - min(mi) = count(DISTINCT mi) - 1 AND max(day(txn_date)) - min(day(txn_date)) <= 7
           AND NOT bool_or(regexp_matches(description, '\\bRENT\\b|ADVANCE|DRIVER|SALARY|\\bWAGES?\\b|\\bHOUSE\\b|MAINTEN', 'i'))
           AS rec_emi
  FROM truth0 WHERE amount < 0 GROUP BY acct, replace(upper(party0), ' ', ''), amount),
atm_days AS (
  SELECT acct, abs(amount) AS size, txn_date, count(*) FILTER (amount < 0) AS outs,
         count(*) FILTER (amount > 0) AS ins
  FROM truth0 WHERE slot = 3 GROUP BY acct, abs(amount), txn_date),
atm_k AS (SELECT *, row_number() OVER (PARTITION BY acct, size ORDER BY txn_date) AS k FROM atm_days),
atm AS (
  SELECT a.*, coalesce(p.txn_date = a.txn_date - 1, false) AS joined,
         CASE WHEN n.txn_date = a.txn_date + 1 THEN n.outs ELSE 0 END AS next_outs
  FROM atm_k a LEFT JOIN atm_k p ON p.acct = a.acct AND p.size = a.size AND p.k = a.k - 1
  LEFT JOIN atm_k n ON n.acct = a.acct AND n.size = a.size AND n.k = a.k + 1),
fold AS (
  SELECT acct, size, txn_date, k, greatest(outs - ins, 0) AS lft,
         least(greatest(ins - outs, 0), next_outs) AS bor,
         least(ins, outs) + least(greatest(ins - outs, 0), next_outs) AS paired
  FROM atm WHERE k = 1
  UNION ALL
  SELECT a.acct, a.size, a.txn_date, a.k, s.today - s.m2, s.m3, s.m1 + s.m2 + s.m3
  FROM fold f JOIN atm a ON a.acct = f.acct AND a.size = f.size AND a.k = f.k + 1,
  LATERAL (SELECT *, least(x.ins - x.m1 - x.m2, x.next_outs) AS m3 FROM (
    SELECT *, least(y.ins - y.m1, y.today) AS m2 FROM (
      SELECT a.ins, a.next_outs, least(a.ins, CASE WHEN a.joined THEN f.lft ELSE 0 END) AS m1,
             a.outs - CASE WHEN a.joined THEN f.bor ELSE 0 END AS today) y) x) s),
truth1 AS (
  SELECT t.*, coalesce(s.rec_nach, false) AND slot = 2 AND t.amount < 0 AS rec_nach,
         coalesce(s.rec_emi, false) AS rec_emi,
         t.slot = 3 AND t.amount > 0 AND row_number() OVER (
           PARTITION BY t.acct, t.slot = 3, abs(t.amount), t.txn_date, t.amount > 0 ORDER BY t.row_seq) <= coalesce(f.paired, 0)
           AS reversed
  FROM truth0 t
  LEFT JOIN series s ON s.acct = t.acct AND s.amount = t.amount AND s.solid = replace(upper(t.party0), ' ', '')
  LEFT JOIN fold f ON t.slot = 3 AND f.acct = t.acct AND f.size = abs(t.amount) AND f.txn_date = t.txn_date),
truth2 AS (
  SELECT *, CASE WHEN reversed THEN 'Reversals & refunds' ELSE party0 END AS party,
    CASE WHEN slot = 12 THEN CASE WHEN rec_emi THEN 'EMI transaction' ELSE 'Regular debit' END
         WHEN slot = 3 THEN CASE WHEN reversed THEN 'return / refund' ELSE 'cash withdrawal' END
         WHEN amount < 0 THEN CASE slot
           WHEN 2 THEN CASE WHEN rec_nach THEN 'EMI transaction' ELSE 'ECS transaction' END
           WHEN 4 THEN 'Salary paid' WHEN 5 THEN 'Outward Bounced Xns'
           WHEN 6 THEN 'Interest / fee payments' WHEN 7 THEN 'other penal charges'
           WHEN 8 THEN 'EMI transaction' ELSE CASE WHEN rec_emi THEN 'EMI transaction' ELSE 'Regular debit' END END
         ELSE CASE slot WHEN 2 THEN 'ECS transaction' WHEN 4 THEN 'Loan amount disbursal'
           WHEN 5 THEN 'cash deposit' WHEN 6 THEN 'Interest received' WHEN 7 THEN 'Salary credited'
           WHEN 8 THEN 'return / refund' ELSE 'Regular credit' END END AS category
  FROM truth1),
tagged AS (
  SELECT *,
    CASE WHEN slot = 3 THEN CASE WHEN reversed THEN 'Reversals & refunds' ELSE 'Cash Withdrawals' END
         WHEN category = 'EMI transaction' THEN 'Loan EMIs'
         WHEN slot = 12 THEN 'Supplier / Vendor Settlements'
         WHEN amount < 0 THEN CASE slot WHEN 4 THEN 'Payroll & Wages' WHEN 5 THEN 'Bank Penalties & Non-Maintenance'
           WHEN 6 THEN 'OD / CC Interest & Renewal Fees' WHEN 7 THEN 'Bank Penalties & Non-Maintenance'
           WHEN 9 THEN 'Gambling / Betting / Real-Money Gaming' WHEN 10 THEN 'GST Payments'
           ELSE 'Supplier / Vendor Settlements' END
         ELSE CASE slot WHEN 2 THEN 'Supplier / Vendor Settlements' WHEN 4 THEN 'Loan Disbursal'
           WHEN 5 THEN 'Direct Cash Deposits' WHEN 6 THEN 'Interest & Treasury Income' WHEN 7 THEN ''
           WHEN 8 THEN 'Reversals & refunds' ELSE 'Business income' END END AS sub_category,
    CASE WHEN reversed THEN 'atm-reversal'
         WHEN slot IN (0, 1, 9, 10, 11, 12) AND amount < 0 THEN CASE WHEN rec_emi THEN 'recurrence-cadence' ELSE 'fallback' END
         WHEN slot IN (0, 1, 9, 10, 11) THEN 'fallback'
         WHEN rec_nach THEN 'recurrence' ELSE 'rule' END AS category_source
  FROM truth2)"""
)


def with_ctes(body: str, base: str = TAGGED) -> str:
    return f"WITH RECURSIVE {base}\n{body}"
