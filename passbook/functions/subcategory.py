"""Sub-category of a tagged row, driven by the sub-category master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import (
    col, sql_text, squash, squash_word, text_array, text_map, words_in,
)
from passbook.vocab import subcategories as S

SHORT = 5  # at or below this squashed length a pattern must be a whole token


def mask_handles(text: Column) -> Column:
    return F.regexp_replace(text, "@[A-Za-z][A-Za-z0-9]*", " ")


def tokens(text: Column) -> Column:
    """Whole tokens; a run joined by . @ _ splits only when all its parts are words."""
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z0-9]+(?:[._@][A-Z0-9]+)*)"), 1)
    worded = F.filter(runs, lambda r: r.rlike(r"^[A-Z]+(?:[._@][A-Z]+)+$"))
    return F.array_distinct(
        F.concat(runs, F.flatten(F.transform(worded, lambda r: F.split(r, "[._@]"))))
    )


def _rank(entries: list[S.Sub]) -> list[tuple[S.Sub, str]]:
    """(entry, squashed pattern) pairs, best score first; the first hit decides.

    A size line with wording of its own is taken outright, so its pairs lead.
    """
    pairs = [(e, squash_word(p), at) for at, e in enumerate(entries) for p in e.patterns]
    key = lambda x: (x[0].ceiling is None, -x[0].priority, -len(x[1]), x[2])
    return [(e, p) for e, p, _ in sorted(pairs, key=key)]


def _side(entries: list[S.Sub]) -> tuple[Column, Column]:
    """(best named line as a struct or null, size-only line or null) for one side."""
    ranked = _rank(entries)
    words = list(dict.fromkeys(p for _, p in ranked))
    long = [w for w in words if len(w) > SHORT]
    short = text_array([w for w in words if len(w) <= SHORT])
    long_words = text_array(long)
    found = F.concat(
        F.array_intersect(F.col("__tok"), short),
        F.transform(words_in(F.col("__hay"), long), lambda i: F.get(long_words, i)),
    )
    at: dict[str, list[int]] = {w: [] for w in words}
    for i, (_, p) in enumerate(ranked):
        at[p].append(i)
    places = F.expr(
        "map(" + ", ".join(f"{sql_text(w)}, array({', '.join(map(str, i))})" for w, i in at.items()) + ")"
    )
    line = "named_struct('name', {}, 'pri', {}, 'tags', cast(array({}) as array<string>))"
    lines = F.expr(
        "array("
        + ", ".join(
            line.format(sql_text(e.name), e.priority, ", ".join(map(sql_text, e.tags))) for e, _ in ranked
        )
        + ")"
    )

    def allowed(i: Column) -> Column:
        tags = F.get(lines, i)["tags"]
        return (F.size(tags) == 0) | F.array_contains(tags, F.col("category"))

    hits = F.flatten(F.transform(found, lambda w: F.element_at(places, w)))
    best = F.get(lines, F.array_min(F.filter(hits, allowed)))
    sized = [
        F.when(F.abs("amount") < e.ceiling * 100, F.lit(e.name))
        for e in reversed(entries)
        if e.ceiling is not None
    ]
    return best, F.coalesce(*sized, F.lit(None).cast("string"))


def with_subcategory(
    df: DataFrame,
    out: str = "sub_category",
    override: str | None = None,
    credit: list[S.Sub] | None = None,
    debit: list[S.Sub] | None = None,
) -> DataFrame:
    """Needs description, party, amount (paise), side and category."""
    keep = [c for c in df.columns if c != out]
    text = mask_handles(F.concat_ws(" ", col("description"), F.coalesce(col("party"), F.lit(""))))
    df = df.withColumn("__txt", text)
    df = df.withColumn("__hay", squash("__txt")).withColumn("__tok", tokens(F.col("__txt")))
    is_credit = credit_side()
    (best_c, sized_c), (best_d, sized_d) = _side(credit or S.CREDIT), _side(debit or S.DEBIT)
    df = df.withColumn("__cr", is_credit)
    cr = F.col("__cr")
    df = df.withColumn("__best", F.when(cr, best_c).otherwise(best_d))
    sized = F.when(cr, sized_c).otherwise(sized_d)
    default = F.coalesce(F.element_at(text_map(S.DEFAULT_BY_TAG), F.col("category")), F.lit(""))
    forced = F.expr(f"nullif({override}, '')") if override else F.lit(None).cast("string")
    generic = F.col("__best").isNull() | (F.col("__best.pri") < 0)
    small = F.when(generic, sized)
    return df.select(*keep, F.coalesce(forced, small, F.col("__best.name"), default).alias(out))


def group_of(name: Column | str) -> Column:
    """The taxonomy group of a sub-category, '' if unknown."""
    return F.coalesce(
        *[F.when(col(name) == e.name, F.lit(e.group)) for e in S.CREDIT + S.DEBIT], F.lit("")
    )


def category_label() -> Column:
    return F.coalesce(F.expr("nullif(sub_category, '')"), F.col("category"))


def credit_side() -> Column:
    """Printed column decides; the sign only when no column was recorded."""
    return F.when(F.coalesce(F.col("side"), F.lit("")) != "", F.col("side") == "credit").otherwise(
        F.col("amount") > 0
    )
