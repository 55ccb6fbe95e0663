"""Operator 10: chat formatting by quotation linking (all in SQL functions).

1. Every message is split into lines; the leading ``>`` marks of a line give its quote
   level. Lines of level 0 are the message's own words, the rest is quoted.
2. Consecutive quoted lines of one level are a passage, however they are wrapped. Passages
   and own text become words (lower case, no punctuation around them, no marks), and every
   ``WINDOW`` words of a passage are hashed; a passage or quoted line of fewer words is hashed
   as one. Each belongs to the latest earlier message of the conversation whose own words
   hold it in a row, so a quote may be a part of a line.
3. A message replies to the message that most of its level-1 windows come from (of all
   its windows if none of level 1 has an origin), each weighed by its words squared; ties go
   to the latest. Without any such window it starts a thread of its own.
4. Threads are numbered by their first message, and a message's place in the conversation is
   (thread, turn): a reply always follows what it quotes. Quotes are cut from the text.

Hot groups: an original is found as a running maximum of turns over (conversation, window),
so no quoted window meets all its possible originals, and no conversation or line lies in one
task. The result has a row per message; a conversation is never collected.

Cases: null texts count as empty; a null role is ``unknown``; a null conv_id is a
conversation of its own, a null turn comes first and is never an original; repeated (conv_id,
turn) rows are messages of their own with one place; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import let, running, text_of
from passbook.session import small_side, stage

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Words of a passage that are looked up together.
WINDOW = 5
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_UNITS = "array<struct<level:int,hash:bigint,weight:int>>"
#: Rounds of pointer doubling are added until no thread gets a new root.
FIRST = -1


def _words(text: Column) -> Column:
    """Words without punctuation around them; those that are all punctuation stay."""
    split = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    return F.transform(split, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, _EDGES, ""), F.lit("")), w))


def _runs(words: Column, size: int) -> Column:
    """The hash of every ``size`` words in a row."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.coalesce(hashes, F.expr("cast(array() as array<bigint>)"))


def _units(lines: Column) -> Column:
    """What is looked up of the quoted lines (level, rest): windows of passages, and short lines."""

    def unit(level: Column, h: Column, size: Column) -> Column:
        return F.struct(level.alias("level"), h.alias("hash"), (size * size).cast("int").alias("weight"))

    def passages(ls: Column) -> Column:
        # A mark where the level changes; one string, so that no list grows line by line.
        marked = F.transform(ls, lambda x, i: F.concat(
            F.when((i > 0) & (F.get(ls, i - 1)["level"] == x["level"]), F.lit(" ")).otherwise(
                F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))
            ),
            F.translate(x["rest"], "\x01\x02", "  "),
        ))
        return F.array_remove(F.split(F.array_join(marked, ""), "\x01"), "")

    def read(p: Column) -> Column:
        words = _words(F.substring_index(p, "\x02", -1))
        return F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), words.alias("words"))

    def windows(p: Column) -> Column:
        level, words = p["level"], p["words"]
        short = F.array(unit(level, F.xxhash64(words), F.size(words)))
        whole = F.transform(_runs(words, WINDOW), lambda h: unit(level, h, F.lit(WINDOW)))
        return F.when(F.size(words) >= WINDOW, whole).otherwise(short)

    def some(ps: Column) -> Column:
        return F.filter(ps, lambda p: (p["level"] > 0) & (F.size(p["words"]) > 0))

    each = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _words(x["rest"]).alias("words")))
    few = F.filter(some(each), lambda p: F.size(p["words"]) < WINDOW)
    joined = some(F.transform(let(lines, passages), read))
    return F.array_distinct(F.flatten(F.transform(F.concat(joined, few), windows)))


def parsed(messages: DataFrame) -> DataFrame:
    """One row per message: its lines as (level, plain) in order, and its own text."""
    line = F.split(text_of(), "\r?\n")

    def read(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, r"[^>]", ""))
        rest = F.when(level > 0, F.regexp_replace(x, _MARKS, "")).otherwise(x)
        plain = F.trim(F.regexp_replace(F.lower(rest), r"\s+", " "))
        return F.struct(level.alias("level"), rest.alias("rest"), plain.alias("plain"))

    rows = messages.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.when(F.instr(text_of(), ">") > 0, F.transform(line, read)).alias("_lines"), text_of().alias("_text"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = F.transform(F.filter("_lines", lambda s: s["level"] == 0), lambda s: s["rest"])
    quoted = F.filter("_lines", lambda s: (s["level"] > 0) & (s["plain"] != ""))
    body = F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(F.trim(F.array_join(own, "\n")))
    return rows.select(
        "row", "conv", "turn", "role", body.alias("body"),
        F.coalesce(F.size(quoted), F.lit(0)).alias("quoted_lines"),
        F.coalesce(let(F.col("_lines"), _units), F.expr(f"cast(array() as {_UNITS})")).alias("quoted"),
    )


def parents(messages: DataFrame) -> DataFrame:
    """(row, parent): the turn that a message replies to, for those with a linked quote."""
    quotes = messages.select("row", "conv", "turn", F.explode("quoted").alias("q")).select(
        "row", "conv", "turn", "q.level", "q.hash", "q.weight"
    )
    quotes = stage(quotes, "thread_quotes")
    asked = stage(quotes.select("conv", "hash").distinct(), "thread_asked")
    # Only conversations with quotes need their messages' windows.
    convs = small_side(stage(asked.select(F.col("conv").alias("_k")).distinct(), "thread_convs"))
    told = messages.where("turn is not null").join(convs, F.col("conv").eqNullSafe(F.col("_k")), "left_semi")

    def hashes(words: Column) -> Column:
        return F.array_distinct(F.concat(*(_runs(words, n) for n in range(1, WINDOW + 1))))

    own = told.select("conv", "turn", F.explode(let(_words(F.col("body")), hashes)).alias("hash"))
    met = asked.select(F.col("conv").alias("_c"), F.col("hash").alias("_h"))
    own = own.join(met, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    # Originals sort after quotes of the same turn, so a message is never its own original.
    events = own.distinct().select(
        "conv", "hash", "turn", F.lit(1).alias("kind"), F.col("turn").alias("own"),
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("int").alias("weight"),
    ).unionByName(quotes.select(
        "conv", "hash", "turn", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("own"), "row", "level", "weight",
    ))
    events = stage(events, "thread_events")
    found = running(
        events, ["conv", "hash"], ["turn", "kind", "row"], {"origin": F.col("own")}, "thread_origins", how="max"
    )
    votes = found.where("kind = 0 and origin is not null").groupBy("row", "origin").agg(
        F.sum(F.when(F.col("level") == 1, F.col("weight")).otherwise(0)).alias("near"), F.sum("weight").alias("votes")
    )
    best = votes.groupBy("row").agg(F.max(F.struct("near", "votes", "origin"))["origin"].alias("parent"))
    return best


def threads(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent, thread, depth and body."""
    read = stage(parsed(messages), "thread_messages")
    linked = stage(parents(read), "thread_parents")
    replies = stage(
        read.select("row", "conv", "turn").join(linked, "row"), "thread_replies"
    )
    # A turn's root: follow parents, twice as far in each round. A turn's first row stands for it.
    step = stage(
        replies.groupBy("conv", "turn").agg(F.max("parent").alias("root")).withColumn("depth", F.lit(1)), "thread_step"
    )
    moved = not step.isEmpty()
    while moved:
        up = step.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        on = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("root") == F.col("_t"))
        after = stage(step.join(up, on, "left"), "thread_step")
        moved = not after.where("_r is not null").isEmpty()
        step = after.select(
            "conv", "turn", F.coalesce("_r", "root").alias("root"),
            (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
        )
    roots = step.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "root", "depth")
    rows = read.join(linked, "row", "left").join(
        roots, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left"
    )
    return rows.select(
        F.col("conv").alias("conv_id"), "turn", "role", "parent",
        F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "quoted_lines", "body", "row",
    )


def chat(messages: DataFrame) -> DataFrame:
    """Messages in reply order: ``place`` counts from 0 within a conversation."""
    placed = running(
        stage(threads(messages), "thread_rows"), ["conv_id"], ["thread", "turn", "row"],
        {"place": F.lit(1).cast("long")}, "thread_places",
    )
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"))
    return placed.select(
        "conv_id", "turn", "role", "parent", "thread", "depth", "quoted_lines",
        (F.col("place") - 1).alias("place"), line.alias("formatted"),
    )
