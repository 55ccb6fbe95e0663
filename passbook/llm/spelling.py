"""Operator 11: spelling variants by permuterm rotations.

A word ``w`` is marked at its end, ``w$``, and written in all its rotations. The rotation
that ends in a given letter of the word shows, before that letter, the rest of the word:
``b$a`` for ``w = a c b``. So with all rotations sorted,

* the words that differ from ``w`` in that letter have rotations with the prefix ``b$a``
  and one letter more (a replacement), and
* the word without that letter has the rotation ``b$a`` itself (a deletion; seen from the
  other side, an insertion).

Each prefix range is one group. The letter after the prefix is the only thing that varies
in it, so a group has at most as many words as the alphabet has letters, and one more: no
group is hot, whatever the table. A letter inside a run of equal letters can be deleted at
each place of the run with the same result; only the first place counts, so each pair of
words meets exactly once.

Rotations of ``LITERAL`` or fewer code points are written out. Longer ones are named by
their length and two polynomial hashes, worked out for all rotations in one pass, so that
a word of 200,000 letters costs 200,000 short rows and not 200,000 long ones.

Words carry a number in code-point order (a sort by range, numbered along it), so that
rotations, neighbours and chains are integers and ties go to the smaller number.

Cases: a null text has no words; a null doc_id is written as the empty string before the
colon; empty texts and tables give no rows; rows that repeat a doc_id count each; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import text_of
from passbook.session import stage

LETTERS = "A-Za-zÀ-ÿ"
RUN, BREAK = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
#: One run in so many loses a letter.
NOISE = 97
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Code points of a text that are read at a time, words held before they are passed on,
#: rows sent to Spark at a time, and code points up to which a rotation is written out.
PIECE, HELD, ROWS, LITERAL = 1 << 20, 200_000, 50_000, 64
END = "$"
#: A Mersenne prime and two numbers below it, for the hashes of long rotations.
MODULUS, BASES = (1 << 61) - 1, (1_000_003_971, 998_244_353_027)

WHOLE, SKIPS, SKIPS_AGAIN = 0, 1, 2


def runs(text: str) -> Counter:
    """The lower-cased runs of letters of a text, with their counts."""
    found, at = Counter(), 0
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    while at < len(text):
        stop = BREAK.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def noisy(doc_id: str, run: str) -> str:
    """The run, short of one letter if the document's checksum says so."""
    check = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if check % NOISE:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            for run, n in runs(text).items():
                word = noisy(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) >= HELD:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
    yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": object, "n": "int64"})


def vocabulary(docs: DataFrame) -> DataFrame:
    """The words (id, word, n) as a stage table; ids rise with the words' code points."""
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_of().alias("text"))
    counts = read.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = stage(counts.where(F.col("n") >= LEAST_COUNT), "spell_counts")
    return stage(
        kept.repartitionByRange("word").sortWithinPartitions("word")
        .select(F.monotonically_increasing_id().alias("id"), "word", "n"),
        "spell_words",
    )


def _hashes(text: str, size: int) -> list[str]:
    """A name for each window of ``size`` in ``text``."""
    codes = list(map(ord, text))
    names = [[] for _ in range(len(codes) - size + 1)]
    for base in BASES:
        lead, now = pow(base, size, MODULUS), 0
        for i, c in enumerate(codes):
            now = (now * base + c) % MODULUS
            if i >= size:
                now = (now - lead * codes[i - size]) % MODULUS
            if i >= size - 1:
                names[i - size + 1].append(now)
    return [f"{size}:{a:x}:{b:x}" for a, b in names]


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """The rotations of ``word$``, whole, and each without its last letter (but not the mark)."""
    ring, size = (word + END) * 2, len(word) + 1

    def windows(n: int) -> list[str]:
        return [ring[i : i + n] for i in range(size)] if n <= LITERAL else _hashes(ring[: size + n - 1], n)

    for key in windows(size):
        yield key, WHOLE
    # The window that starts after the letter at i, without that letter.
    for start, key in enumerate(windows(size - 1)):
        at = (start - 1) % size
        if at < len(word):
            yield key, SKIPS_AGAIN if at and word[at - 1] == word[at] else SKIPS


def _rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[str, int, int, int]] = []
    for batch in batches:
        for number, word, n in zip(batch["id"], batch["word"], batch["n"], strict=True):
            for key, kind in rotations(word):
                rows.append((key, kind, number, n))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=["key", "kind", "id", "n"])
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["key", "kind", "id", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n, other, other_n) for every ordered pair of near words, once."""
    rotated = words.mapInPandas(_rotated, "key string, kind int, id long, n long")
    member = F.struct("kind", "id", "n")
    ranges = rotated.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("of")).where(F.size("of") > 1)
    each = ranges.select(F.explode("of").alias("a"), "of").select("a", F.explode("of").alias("b"))
    replaced = (F.col("a.kind") != WHOLE) & (F.col("b.kind") != WHOLE)
    deleted = F.col("a.kind") + F.col("b.kind") == WHOLE + SKIPS
    met = each.where((F.col("a.id") != F.col("b.id")) & (replaced | deleted))
    return met.select(
        F.col("a.id").alias("id"), F.col("a.n").alias("n"), F.col("b.id").alias("other"), F.col("b.n").alias("other_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word of the chain of forms from each id that has one.

    A form is at least twice as frequent as its word, so chains end, and following two
    links at a time takes a round for each doubling of the longest chain.
    """
    now, step = stage(forms.select("id", F.col("form_id").alias("root")), "spell_links_0"), 0
    while True:
        onward = now.select(F.col("id").alias("_from"), F.col("root").alias("_to"))
        if now.join(onward, F.col("root") == F.col("_from"), "left_semi").isEmpty():
            return now
        step += 1
        now = now.join(onward, F.col("root") == F.col("_from"), "left")
        now = stage(now.select("id", F.coalesce("_to", "root").alias("root")), f"spell_links_{step}")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = vocabulary(docs)
    best = neighbours(words).groupBy("id").agg(
        F.first("n").alias("own_n"), F.count("*").alias("n_near"),
        F.max(F.struct("other_n", -F.col("other"))).alias("top"),
    )
    has_form = F.col("top.other_n") >= TIMES * F.col("own_n")
    best = stage(
        best.select(
            "id", "n_near", F.when(has_form, -F.col("top.col2")).alias("form_id"),
            F.when(has_form, F.col("top.other_n")).alias("form_n"),
        ),
        "spell_best",
    )
    found = best.join(roots(best.where("form_id IS NOT NULL")), "id", "left")
    form = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = words.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    named = found.join(form, "form_id", "left").join(root, "root", "left")
    out = words.join(named.select("id", "n_near", "form", "form_n", "_root"), "id", "left")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
        F.coalesce("_root", "word").alias("root"),
    )
