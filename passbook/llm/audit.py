"""Operator 13: how filters interact, kept up to date over a stream of files.

Five filters are applied to documents in every order. What an order's steps remove follows
from the number of documents of each part that fail each set of filters, so those counters
(at most 32 masks a part, by label) are all that the report needs.

Filters A to D depend on the document alone. E depends on the whole table: a document fails
it if a smaller id anywhere has its text. As files arrive in micro-batches, the document
that passes E today can be the copy of a smaller id tomorrow. Each text therefore has
state: its least id so far and the rows that bear it. A batch joins its texts with their
state; where the least id falls, the rows of the earlier one are taken out of their counter
and put into the one whose mask has E. Counters only add up such changes.

Texts are known by their SHA-256, so state is about a hundred bytes for each different
text. It is a log: each batch writes, per text and class of rows, its least id; the state
before a batch is what earlier batches wrote, and counters are the sum of all changes. A
batch that is run again writes its part of the log again. Copies of one text are counted by
class before they meet under their text, so a text that fills a third of the table arrives
as a few rows.

Cases: a null text is empty; a null source is the part of the empty string; a null doc_id
is neither smaller nor larger than another, so such a row never fails E; rows that repeat
the least id pass E all; a document is good or toxic if any of its labels says so; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.llm.common import SPACE, let, text_of
from passbook.session import stage, stage_root

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MASKS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
#: Micro-batches that the files of a table are read in (fewer if there are fewer files).
BATCHES = 4
CLASS = ["part", "mask", "good", "toxic"]


def own_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    bit = lambda fails, f: F.when(fails, BIT[f]).otherwise(0)
    words = F.array_remove(F.split(text, SPACE), "")
    wording = let(
        words,
        lambda w: bit(F.size(w) < LEAST_WORDS, "A")
        + bit(100 * F.size(F.array_distinct(w)).cast("long") < DISTINCT_PERCENT * F.size(w).cast("long"), "B"),
    )
    length = F.length(text).cast("long")
    upper = length - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (wording + bit(100 * upper > UPPER_PERCENT * length, "C") + bit(text.rlike(MARKS), "D")).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per labelled document."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )


def classed(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of a batch by text and class: how many, the least id, and how many bear it."""
    text = text_of()
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own_mask(text).alias("mask"),
        F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2(text.cast("binary"), 256))).alias("sha"),
    ).join(flags, "doc_id", "left").fillna(False, ["good", "toxic"])
    by_id = rows.groupBy("doc_id", "sha", *CLASS).agg(F.count("*").alias("n"))
    return by_id.groupBy("sha", *CLASS).agg(
        F.sum("n").alias("every"), F.min(F.struct("doc_id", "n")).alias("low")
    ).select("sha", *CLASS, "every", F.col("low.doc_id").alias("least"), F.col("low.n").alias("bear"))


def changes(fresh: DataFrame, before: DataFrame | None) -> DataFrame:
    """What a batch does to the counters: rows (part, mask, good, toxic, n), n of either sign."""
    fails, passes = F.col("mask").bitwiseOR(F.lit(BIT["E"])), F.col("mask")
    known = fresh.where("sha IS NOT NULL").withColumn("new", F.lit(True))
    if before is not None:
        touched = known.select("sha").distinct()
        known = known.unionByName(before.join(touched, "sha", "left_semi").withColumn("new", F.lit(False)))
    by_text = Window.partitionBy("sha")
    # One row for each text, id and class; those of the least id pass E.
    bear = known.repartition("sha").groupBy("sha", "least", *CLASS).agg(
        F.sum("bear").alias("now"), F.coalesce(F.sum(F.when(~F.col("new"), F.col("bear"))), F.lit(0)).alias("was")
    )
    least = F.min("least").over(by_text)
    least_before = F.min(F.when(F.col("was") > 0, F.col("least"))).over(by_text)
    first = (
        F.when(F.col("least") == least, F.col("now")).otherwise(0)
        - F.when(F.col("least") == least_before, F.col("was")).otherwise(0)
    )
    moved = bear.withColumn("n", first).where("n <> 0")
    moved = moved.select(*CLASS, "n").unionByName(
        fresh.where("sha IS NULL").select(*CLASS, F.col("every").alias("n"))
    )
    moved = moved.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(passes.alias("mask"), F.col("n").alias("n")), F.struct(fails.alias("mask"), (-F.col("n")).alias("n"))
        )),
    )
    came = fresh.select("part", "good", "toxic", fails.alias("mask"), F.col("every").alias("n"))
    return came.unionByName(moved).groupBy(*CLASS).agg(F.sum("n").alias("n"))


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The counters (part, mask, good, toxic, n) after all files of ``path`` have been read."""
    table = spark.read.parquet(path)
    root = os.path.join(stage_root(spark), f"audit-{uuid.uuid4().hex}")
    flags = stage(label_flags(labels), "audit_labels")
    log = lambda kind, k: f"{root}/{kind}/batch={k}"
    seen: dict[int, str] = {}

    def absorb(batch: DataFrame, k: int) -> None:
        classed(batch, flags).write.mode("overwrite").parquet(log("texts", k))
        fresh = spark.read.parquet(log("texts", k))
        earlier = [p for b, p in sorted(seen.items()) if b < k]
        before = spark.read.schema(fresh.schema).parquet(*earlier) if earlier else None
        changes(fresh, before).write.mode("overwrite").parquet(log("changes", k))
        seen[k] = log("texts", k)

    files = table.inputFiles()
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
    folder, name = path.rstrip("/").rsplit("/", 1)
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == name:
        # A stream reads folders; of this one, only the file.
        reader, path = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(path).select("doc_id", "text", "source")
    run = (
        stream.writeStream.foreachBatch(absorb).trigger(availableNow=True)
        .option("checkpointLocation", f"{root}/progress").start()
    )
    run.awaitTermination()
    if not seen:
        return spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean, n long")
    every = spark.read.parquet(*(log("changes", k) for k in seen))
    return every.groupBy(*CLASS).agg(F.sum("n").alias("n"))


def steps() -> Column:
    """Every order and step: the filter's place, and the masks of the filters before and up to it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            rows.append(F.struct(
                F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"),
                F.lit(FILTERS.index(f)).alias("f"), F.lit(before).alias("before"),
                F.lit(before | BIT[f]).alias("after"),
            ))
            before |= BIT[f]
    return F.array(*rows)


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counters."""
    zero = F.lit(0).cast("long")
    measures = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [
        F.coalesce(F.sum(F.when((F.col("mask") == m) & of, F.col("n"))), zero).alias(f"{k}_{m}")
        for k, of in measures.items() for m in range(MASKS)
    ]
    parts = counts.groupBy("part").agg(*sums)
    # Documents of the part that pass every filter of a set.
    passing = {
        k: F.array(*(
            sum((F.col(f"{k}_{m}") for m in range(MASKS) if not m & s), zero) for s in range(MASKS)
        )).alias(f"{k}_pass") for k in measures
    }
    parts = parts.select("part", F.array(*(F.col(f"all_{BIT[f]}") for f in FILTERS)).alias("alone"), *passing.values())

    def pass_of(kind: str, masks: Column | int) -> Column:
        return F.get(F.col(f"{kind}_pass"), masks if isinstance(masks, Column) else F.lit(masks))

    def all_orders(f: str) -> Column:
        terms = []
        for s in (s for s in range(MASKS) if not s & BIT[f]):
            k = s.bit_count()
            orders = math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)
            terms.append(orders * (pass_of("all", s) - pass_of("all", s | BIT[f])))
        return sum(terms[1:], terms[0])

    parts = parts.withColumn("shapleys", F.array(*(all_orders(f) for f in FILTERS)))
    failing = F.array(*(pass_of("all", 0) - pass_of("all", BIT[f]) for f in FILTERS))
    parts = parts.withColumn("failing", failing)
    laid = parts.select("*", F.inline(steps()))
    lost = {k: pass_of(k, F.col("before")) - pass_of(k, F.col("after")) for k in measures}
    return laid.select(
        "part", "filter_order", "step", pass_of("all", F.col("after")).alias("kept"), lost["all"].alias("removed"),
        (F.get("failing", F.col("f")) - lost["all"]).alias("redundant"), F.get("alone", F.col("f")).alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.get("shapleys", F.col("f")).alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The report over the Parquet files of ``path``, read as a stream."""
    return report(stage(counters(spark, path, labels, batches), "audit_counters"))
