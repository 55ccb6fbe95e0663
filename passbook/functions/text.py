"""Small text helpers used by every rule family; all of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hit(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """True when the pattern occurs anywhere (null text counts as no match)."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}" if ignore_case else pattern), F.lit(False))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def literal_any(words: list[str], prefix: str = "") -> str:
    """One alternation over escaped words, each behind ``prefix``."""
    return any_of([prefix + re.escape(w).replace(r"\ ", " ") for w in words])


def contains_any(c: Column, keys: list[str]) -> Column:
    """Substring tests joined by OR: far cheaper per row than one wide regex."""
    return reduce(lambda a, b: a | b, [c.contains(k) for k in keys])


def gated_hit(upper: Column, text: Column, pattern: str, gate: str) -> Column:
    """``hit`` behind a substring gate.

    ``gate`` lists upper-case literals (separated by |) one of which every match of the
    pattern contains, so rows without any of them skip the regex.
    """
    return contains_any(upper, gate.split("|")) & hit(text, pattern)


def _prefix_tree(words: list[str]) -> str:
    """One regex for many words that reads each shared prefix once, longest word first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    arms = [re.escape(h) + _prefix_tree(rest) for h, rest in heads.items()]
    if not arms:
        return ""
    body = arms[0] if len(arms) == 1 and "" not in words else "(?:" + "|".join(arms) + ")"
    return body + "?" if "" in words else body


def words_in(c: Column, words: list[str]) -> Column:
    """Positions (in ``words``) of every word contained in the text, as an array.

    The look-ahead yields the longest word at each place of the text; words that are a
    prefix of it are there as well, so each find expands to its contained words.
    """
    inside = {w: [i for i, x in enumerate(words) if w.startswith(x)] for w in words}
    lookup = F.expr(
        "map(" + ", ".join(f"{sql_text(w)}, array({', '.join(map(str, at))})" for w, at in inside.items()) + ")"
    )
    finds = F.regexp_extract_all(c, F.lit(f"(?=({_prefix_tree(words)}))"), 1)
    return F.flatten(F.transform(F.array_distinct(finds), lambda w: F.element_at(lookup, w)))


def sql_text(s: str) -> str:
    """A string as a SQL literal; wide literal tables parse far faster than Column calls."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(words: list[str]) -> Column:
    return F.expr(f"cast(array({', '.join(map(sql_text, words))}) as array<string>)")


def text_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items()) + ")")


def first_listed(c: Column, keys: dict[str, str]) -> Column:
    """Value of the first key (dict order) contained in the text, else null."""
    found = F.filter(text_array(list(keys)), lambda k: c.contains(k))
    return F.when(contains_any(c, list(keys)), F.element_at(text_map(keys), F.get(found, F.lit(0))))


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def scrub(c: Column | str) -> Column:
    """Drop control bytes but keep tab and newline."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def squash(c: Column | str, keep: str = "A-Z0-9") -> Column:
    """Upper case without anything outside ``keep``."""
    return F.regexp_replace(F.upper(col(c)), f"[^{keep}]", "")


def squash_word(s: str, keep: str = "A-Z0-9") -> str:
    return re.sub(f"[^{keep}]", "", s.upper())


def n_letters(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}]", ""))


def n_digits(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^0-9]", ""))


def strip(c: Column | str, chars: str) -> Column:
    """Trim any of ``chars`` from both ends."""
    cls = "[" + re.escape(chars) + "]+"
    return F.regexp_replace(col(c), f"^{cls}|{cls}$", "")


def party_key(c: Column | str) -> Column:
    """First twelve upper-case alphanumerics of a party name."""
    return F.substring(F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^A-Za-z0-9]", "")), 1, 12)


def blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""
