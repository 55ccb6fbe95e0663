"""Tables over many statements, accounts and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.party import party_kind
from passbook.functions.subcategory import category_label
from passbook.operators.ordered import with_running
from passbook.vocab import keywords as K

FILE = ["acct", "file_idx"]
#: How far a figure may move; any change beyond is drift.
DRIFT = {"rows": 0.0, "not_reconciling": 0.0, "party_named_pct": 1.0, "mean_desc_len": 3.0}
MIX_DRIFT = 3.0
TOP_CATEGORIES = 6
#: Minutes without progress after which a job counts as stuck.
IDLE = {"awaiting_upload": 60, "processing": 20, "merging": 20}
NO_LAYOUT = "no layout"
#: I16: rows that should name a party, of which a tenth must, and banks that number members instead.
NAMEABLE, UNNAMEABLE = r"(?i)UPI|NEFT|RTGS|IMPS|MMT|ACH|TRANSFER|TRF|INF[/-]", r"(?i)UPISETTLEMENT|\bPOS\b|ATW-|CHRGS|/GST/|CASH"
FLOOR_ROWS, FLOOR_SHARE, CO_OPERATIVE = 25, 0.10, r"(?i)co[- ]?op"


def usable_files(files: DataFrame, failed: DataFrame) -> DataFrame:
    """The files of a job that did not fail."""
    return files.join(failed.select("job_id", "idx"), ["job_id", "idx"], "left_anti")


def account_groups(files: DataFrame) -> DataFrame:
    """One row per job and account, numbered as the accounts appear in upload order.

    A job is one upload of a few files, so its lists and windows are short.
    """
    groups = files.groupBy("job_id", "bank", "account_no").agg(
        F.sort_array(F.collect_list(F.struct("idx", "source_file"))).alias("of"), F.min("idx").alias("first")
    )
    w = Window.partitionBy("job_id").orderBy("first")
    names = F.transform("of", lambda x: x["source_file"])
    return groups.select("job_id", "bank", "account_no", F.row_number().over(w).alias("group_no"), names.alias("files"))


def collapsed_periods(ranges: DataFrame, key: str = "acct") -> DataFrame:
    """Ranges (``lo``, ``hi``: dates) that touch or overlap as one; gaps of a day or more stay.

    A range begins a period if it starts more than a day after everything before it ended.
    What ended before is a maximum within the year of its start, and over earlier years one
    row per year, so the ranges of one key are never sorted in one task.
    """
    known = ranges.where("lo IS NOT NULL AND hi IS NOT NULL").select(key, "lo", "hi").withColumn("year", F.year("lo"))
    known = known.groupBy(key, "year", "lo").agg(F.max("hi").alias("hi"))
    years = known.groupBy(key, "year").agg(F.max("hi").alias("__hi"))
    before = Window.partitionBy(key).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select(F.col(key).alias("__k"), F.col("year").alias("__y"), F.max("__hi").over(before).alias("__past"))
    inside = Window.partitionBy(key, "year").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    seen = known.join(years, F.col(key).eqNullSafe(F.col("__k")) & (F.col("year") == F.col("__y")))
    ended = F.greatest(F.max("hi").over(inside), F.col("__past"))
    seen = seen.withColumn("new", F.coalesce(F.datediff("lo", ended) > 1, F.lit(True)).cast("int"))
    numbered = with_running(seen.select(key, "year", "lo", "hi", "new"), [key], "year", ["lo"], sums={"period": "new"})
    return numbered.groupBy(key, "period").agg(F.min("lo").alias("period_from"), F.max("hi").alias("period_to"))


def masked(account: Column) -> Column:
    """All but the last four characters as X."""
    return F.concat(F.repeat(F.lit("X"), F.greatest(F.length(account) - 4, F.lit(0))), F.right(account, F.lit(4)))


def slug(bank: Column, account: Column) -> Column:
    """I4: a name for an account that is safe in a path."""
    plain = F.regexp_replace(F.lower(F.concat(bank, F.lit("-"), account)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(plain, F.lit("-")), F.lit("")), F.lit("account"))


def title(holder: Column, bank: Column, masked_no: Column) -> Column:
    """I4: holder, short bank name and masked number, as far as they are known."""
    short = F.create_map(*[F.lit(x) for pair in K.SHORT_BANKS.items() for x in pair])
    name = F.coalesce(F.try_element_at(short, F.lower(F.trim(bank))), F.trim(bank))
    return F.concat_ws(" - ", *(F.nullif(c, F.lit("")) for c in (holder, name, masked_no)))


def account_rollup(rows: DataFrame, headers: DataFrame, status: DataFrame) -> DataFrame:
    """One row per account: who, how much, and whether it reconciles."""
    counts = rows.groupBy("acct").agg(F.count(F.lit(1)).alias("rows"))
    name = F.nullif("account_name", F.lit(""))
    files = headers.groupBy("acct").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n_pages", F.lit(0))).alias("pages"),
        F.min_by("bank", "file_idx").alias("bank"), F.min_by("account_no", "file_idx").alias("number"),
        F.min_by(name, F.when(name.isNotNull(), F.col("file_idx"))).alias("holder"),
        F.sum(F.size("unreadable_pages")).cast("bigint").alias("unreadable_pages"), F.min("job_id").alias("job_id"),
    )
    hidden = masked(F.col("number"))
    joined = counts.join(files, "acct").join(status, "acct")
    return joined.select(
        "acct", "job_id", slug(F.col("bank"), hidden).alias("slug"), "bank", hidden.alias("account_no"),
        F.coalesce("holder", F.lit("")).alias("holder"), title(F.col("holder"), F.col("bank"), hidden).alias("title"),
        "rows", "pages", "files", "unreadable_pages", F.col("status").alias("validation"), "issues",
    )


def account_maps(rows: DataFrame) -> DataFrame:
    """Per account maps of counts by category, tag, confidence and party quality, and of
    amounts by category. Keys are labels of fixed lists, so maps are short."""
    kind = party_kind("party", "description")
    entry = lambda name, key: F.struct(F.lit(name).alias("map"), key.alias("key"))
    entries = F.array_compact(F.array(
        entry("categories", category_label()), entry("tags", F.col("category")), entry("confidence", F.col("confidence")),
        F.when(kind != "na", entry("party_quality", kind)),
    ))
    counted = rows.select("acct", "amount", F.inline(entries)).groupBy("acct", "map", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("size")
    )
    of = lambda name, value: F.map_from_entries(
        F.sort_array(F.collect_list(F.when(F.col("map") == name, F.struct("key", value))))
    )
    return counted.groupBy("acct").agg(
        of("categories", "n").alias("categories"), of("categories", "size").alias("category_amounts"), of("tags", "n").alias("tags"),
        of("confidence", "n").alias("confidence"), of("party_quality", "n").alias("party_quality"),
    )


def job_rollup(accounts: DataFrame, failed: DataFrame) -> DataFrame:
    """Sums over a job's accounts; it needs review unless all passed and no file failed."""
    rank = F.when(F.col("validation") == "failed", 2).when(F.col("validation") == "passed_with_warnings", 1).otherwise(0)
    jobs = accounts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("rows").alias("rows"), F.sum("pages").alias("pages"), F.sum("files").alias("files"),
        F.sum("issues").alias("issues"), F.max(rank).alias("__worst"),
    )
    lost = failed.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed_files"))
    worst = F.when(F.col("__worst") == 2, "failed").when(F.col("__worst") == 1, "passed_with_warnings").otherwise("passed")
    n = F.coalesce("failed_files", F.lit(0))
    return jobs.join(lost, "job_id", "left").select(
        "job_id", "accounts", "rows", "pages", "files", "issues", n.alias("failed_files"), worst.alias("validation"),
        F.when((n > 0) | (F.col("__worst") > 0), "needs_review").otherwise("done").alias("status"),
    )


def extraction_cost(usage: DataFrame) -> DataFrame:
    """What model extraction took per job; the cost is unknown if any part of it is.

    ``usage``: job_id, tokens_in, tokens_out, calls, micro_usd; all null for files read
    without a model.
    """
    used = F.col("calls").isNotNull()
    unknown = F.max(F.coalesce(used & F.col("micro_usd").isNull(), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return usage.groupBy("job_id").agg(
        F.count_if(used).alias("ai_files"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"),
        total("calls").alias("calls"), F.when(~unknown & (total("calls") > 0), total("micro_usd")).alias("micro_usd"),
    )


def corpus_profile(rows: DataFrame, files: DataFrame) -> DataFrame:
    """I8: figures per layout, with the shares of its commonest categories as a map.

    ``rows`` are tagged and have ``layout``; ``files``: layout, status, null if unreadable.
    """
    kind = party_kind("party", "description")
    text = F.length(F.coalesce("description", F.lit("")))
    facts = rows.groupBy("layout").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kind == "named").alias("named"), F.count_if(kind == "handle").alias("handle"),
        F.count_if(kind == "na").alias("na"), F.sum(text).alias("letters"),
    )
    of_files = files.groupBy("layout").agg(
        F.count("status").alias("files"), F.count_if(F.col("status").isNull()).alias("unreadable_files"),
        F.count_if(F.col("status") != "passed").alias("not_reconciling"),
    )
    mix = rows.groupBy("layout", category_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("layout").orderBy(F.desc("n"), "label")
    top = mix.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= TOP_CATEGORIES)
    share = lambda n, of: F.round(1000.0 * n / F.greatest(of, F.lit(1))) / 10.0
    top = top.join(facts.select("layout", F.col("rows").alias("__rows")), "layout")
    top = top.groupBy("layout").agg(
        F.map_from_entries(F.collect_list(F.struct("label", share(F.col("n"), F.col("__rows"))))).alias("top_categories")
    )
    joined = of_files.join(facts, "layout", "left").join(top, "layout", "left")
    n = F.coalesce("rows", F.lit(0))
    return joined.select(
        "layout", "files", "unreadable_files", n.alias("rows"), "not_reconciling",
        share(F.coalesce("named", F.lit(0)), n).alias("party_named_pct"),
        share(F.coalesce(F.col("named") + F.col("handle"), F.lit(0)), n - F.coalesce("na", F.lit(0))).alias("party_nameable_pct"),
        F.coalesce(F.round(10.0 * F.col("letters") / F.col("rows")) / 10.0, F.lit(0.0)).alias("mean_desc_len"), "top_categories",
    )


def _figures(profile: DataFrame, name: str) -> DataFrame:
    """A profile in long form: layout, metric, category, value."""
    none = F.lit(None).cast("string")
    rows = [F.struct(F.lit(m).alias("metric"), none.alias("category"), F.col(m).cast("double").alias("value")) for m in DRIFT]
    mix = F.transform(
        F.map_entries("top_categories"), lambda e: F.struct(F.lit("category").alias("metric"), e["key"].alias("category"), e["value"].alias("value"))
    )
    every = F.concat(F.array(*rows), F.coalesce(mix, F.array().cast("array<struct<metric:string,category:string,value:double>>")))
    return profile.select("layout", F.inline(every)).withColumnRenamed("value", name)


def drift(base: DataFrame, now: DataFrame) -> DataFrame:
    """What differs between two profiles beyond the thresholds.

    Layouts of one side only are one row each, ``new`` or ``missing``; of the others, each
    figure that moved too far. A category that is not among the commonest counts as 0.
    """
    sides = base.select("layout", F.lit(True).alias("__b")).join(now.select("layout", F.lit(True).alias("__n")), "layout", "full")
    once = sides.where("__b IS NULL OR __n IS NULL").select(
        "layout", F.when(F.col("__b").isNull(), "new").otherwise("missing").alias("metric"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"),
    )
    both = sides.where("__b AND __n").select(F.col("layout").alias("__l"))
    b, n = _figures(base, "before"), _figures(now, "after")
    same = (b["layout"] == n["layout"]) & (b["metric"] == n["metric"]) & b["category"].eqNullSafe(n["category"])
    pick = lambda c: F.coalesce(b[c], n[c]).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    met = b.join(n, same, "full").select(pick("layout"), pick("metric"), pick("category"), zero("before"), zero("after"))
    limits = F.create_map(*[F.lit(x) for pair in DRIFT.items() for x in pair])
    limit = F.coalesce(F.try_element_at(limits, F.col("metric")), F.lit(MIX_DRIFT))
    moved = met.where(F.abs(F.col("after") - F.col("before")) > limit).join(both, F.col("layout") == F.col("__l"), "left_semi")
    return once.unionByName(moved)


def sweep(rows: DataFrame, detail: Column) -> DataFrame:
    """Defects that a reader would see at once, one row per row and kind, with evidence."""
    p, d = F.trim(F.coalesce("party", F.lit(""))), F.coalesce("description", F.lit(""))
    tag, amt = F.col("category"), F.col("amount")
    signs = F.create_map(*[F.lit(x) for pair in K.TAG_SIGN.items() for x in pair])
    sign = F.try_element_at(signs, tag)
    many = lambda c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit(""))) >= 2
    code = F.replace(p, F.lit(" "), F.lit("")).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$")
    furniture = r"(?i)page \d+ of|page no|statement of account|opening balance|closing balance|carried forward|brought forward|computer generated|do not share|registered office"  # noqa: E501
    one = lambda when, kind, why: F.when(when, F.struct(F.lit(kind).alias("kind"), why.alias("evidence")))
    beginning = F.substring(d, 1, 60)
    fault = (
        F.when(p == "", None).when(F.upper(p).isin(K.SWEEP_STAMPS), "party_is_channel_word")
        .when((F.length(p) <= 2) & ~p.rlike(r"^\d+$"), "party_too_short").when(code, "party_is_ifsc")
        .when(many("/") | many("*"), "party_has_junk_chars")
    )
    name = F.when(fault.isNotNull(), F.struct(fault.alias("kind"), p.alias("evidence")))
    found = F.array_compact(F.array(
        name, one(F.trim(d) == "", "empty_description", F.lit("")),
        one(d.rlike(furniture), "footer_or_header_in_description", beginning),
        one(d.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control_chars_in_description", F.substring(d, 1, 40)),
        one(F.regexp_count(d, F.lit(r"UPI/(?:DR|CR)/\d{9,}")) > 1, "two_transactions_merged", beginning),
        one(F.coalesce((amt > 0) != (sign > 0), F.lit(False)), "category_contradicts_sign", F.concat(tag, F.lit(" @ "), amt.cast("string"))),
        one((tag == K.EMI) & (F.abs(amt) < 10_000), "emi_under_100", amt.cast("string")),
        one(detail.contains("unknown party") & (p != ""), "detail_says_unknown_but_party_known", p),
    ))
    return rows.select(*FILE, "row_seq", F.inline(found))


def sweep_digest(defects: DataFrame, examples: int = 5) -> DataFrame:
    """Defects by kind, with the first few as examples."""
    w = Window.partitionBy("kind").orderBy(*FILE, "row_seq")
    first = defects.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= examples)
    shown = first.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(*FILE, "row_seq", "evidence"))).alias("examples"))
    return defects.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(shown, "kind")


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows and hits per true category. Both have ``description`` and ``amount``."""
    key = ["description", "amount"]
    found = predicted.select(*key, F.col("category").alias("__got")).dropDuplicates(key)
    joined = truth.join(found, key, "left")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == F.col("__got")).alias("hits"))


def layout_queue(failed: DataFrame) -> DataFrame:
    """Failed files that wait for a layout, newest job first (``place``)."""
    waiting = failed.where(F.lower("error").contains(NO_LAYOUT))
    waiting = waiting.withColumn("day", F.to_date("created_at")).withColumn("__back", -F.unix_timestamp("created_at"))
    waiting = waiting.withColumn("__seg", -F.datediff("day", F.lit("1970-01-01")))
    numbered = with_running(waiting.withColumn("__one", F.lit(0)), ["__one"], "__seg", ["__back", "job_id", "idx"], index="place")
    return numbered.drop("day", "__back", "__seg", "__one")


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Live jobs without progress for longer than their status allows."""
    limits = F.create_map(*[F.lit(x) for pair in IDLE.items() for x in pair])
    since = F.coalesce("updated_at", "created_at")
    idle = F.unix_timestamp(now) - F.unix_timestamp(since)
    allowed = F.try_element_at(limits, F.col("status")) * 60
    return jobs.withColumn("idle_minutes", F.floor(idle / 60).cast("bigint")).where(idle > allowed)


def recent_jobs(jobs: DataFrame, most: int = 60) -> DataFrame:
    """The newest jobs of each owner."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), "job_id")
    return jobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def layout_samples(files: DataFrame, per_layout: int = 2) -> DataFrame:
    """The first files of each layout by bank, size and path."""
    w = Window.partitionBy("layout").orderBy("bank", "size", "path")
    return files.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_layout)


def party_floor(rows: DataFrame) -> DataFrame:
    """I16: statements in which far too few of the rows that should name a party do."""
    should = F.col("description").rlike(NAMEABLE) & ~F.col("description").rlike(UNNAMEABLE)
    named = should & (F.coalesce("party", F.lit("")) != "") & (F.col("party") != "unknown party")
    per = rows.groupBy(*FILE, "bank").agg(F.count_if(should).alias("nameable"), F.count_if(named).alias("filled"))
    low = (F.col("nameable") >= FLOOR_ROWS) & (F.col("filled") < FLOOR_SHARE * F.col("nameable"))
    return per.where(low & ~F.col("bank").rlike(CO_OPERATIVE))
