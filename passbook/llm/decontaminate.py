"""Operator 2: benchmark decontamination by template windows with slot checks.

Words become templates: numbers, names (capitalised words inside a sentence) and units
after a number turn into typed placeholders, whose words are kept as slots; all else is
lower-cased. Every window of ``WINDOW`` template words of the benchmark is hash-joined
with the documents' windows and compared word by word. Matches that line up (same distance
between the two places) form an alignment. Its windows with unchanged slots always count.
The others count if the alignment's names map one to one (the same benchmark name always
became the same other name), in the longest run of windows in which a number or unit always
became the same other one; two numbers may become one. A document is linked to an item if the consistent alignments cover ``RUN_WINDOWS`` windows of it (13 words in a row
for a window of 8), or ``COVERAGE`` of all its windows.

Documents first test a window's hash against a bitmap of the benchmark's hashes, whose size
is fixed (``2 ** BITMAP_BITS`` bits), whatever the benchmark's; only windows that pass are
emitted and joined.

A window with fewer than ``LITERALS`` plain words says too little as a template, so it is
matched word by word as it stands, numbers, names and units included.

Cases: null texts count as empty and link to nothing; items of fewer than ``WINDOW`` words are looked up as one window
of their own length, those under ``LITERALS`` words not at all; repeated documents and items
give one row per pair of ids; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from passbook.llm.common import text_of, with_rows
from passbook.session import stage

WINDOW = 8
LITERALS = 5
RUN_WINDOWS = 6
COVERAGE = 0.5
BITMAP_BITS = 24
#: Distinct words whose hashes a task keeps.
CACHE = 200_000
#: Units of measure and money that may follow a number.
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms "
    "ounce ounces oz pound pounds lb lbs ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar "
    "dollars euro euros rupee rupees percent degree degrees meter meters metre metres kilometer kilometers kmh mph".split()
)
#: A word, with the end of the sentence before it if there is one.
_TOKEN = re.compile(r"(?:[.!?:\n][\s\"'(]*)?(?:[^\W\d]\w*|\d+(?:[.,:/]\d+)*|[%$€£°])")
_LEAD = re.compile(r"[.!?:\n][\s\"'(]*")
_KINDS = ("", "<number>", "<name>", "<unit>")
_MULTIPLIER = 0x9E3779B97F4A7C15


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=1)


def plain_word(token: str) -> str:
    """A token without what leads it."""
    lead = _LEAD.match(token)
    return token[lead.end() :] if lead else token


class Templates(dict):
    """Turns texts into template words. Maps tokens to numbers, up to ``CACHE`` of them."""

    def __init__(self):
        super().__init__()
        self.slots = [_hash(k) for k in _KINDS]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes = np.zeros(CACHE, np.uint64)
        self.literals = np.zeros(CACHE, np.uint64)
        self.kinds = np.zeros(CACHE, np.int8)

    def __missing__(self, token: str) -> int:
        """Numbers a token that is new, with its hash and kind."""
        word, at = plain_word(token), len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.literals = np.concatenate([self.literals, np.zeros_like(self.literals)])
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        if word[0].isdigit():
            kind = 1
        elif word is token and len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = 2
        else:
            kind = 0
        self.literals[at], self.kinds[at] = _hash(word.lower()), kind
        self.hashes[at] = self.slots[kind] if kind else self.literals[at]
        self[token] = at
        return at

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Template hashes, literal hashes, kinds and tokens of a text."""
        if len(self) >= CACHE:
            self.reset()
        words = _TOKEN.findall(text)
        if words and words[0] == plain_word(words[0]):
            words[0] = "\n" + words[0]  # a text begins a sentence
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h, literal, k = self.hashes[at], self.literals[at], self.kinds[at]
        for i in np.flatnonzero(k[:-1] == 1) + 1 if len(k) else ():
            if plain_word(words[i]).lower() in UNITS:
                h[i], k[i] = self.slots[3], 3
        return h, literal, k, words

    def windows(self, h: np.ndarray, literal: np.ndarray, k: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window of ``size``, and whether it has enough plain words for a template.

        Windows that have not are hashed by their literal words.
        """
        n = len(h) - size + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(n, np.uint64)
        plain = np.zeros(n, np.int16)
        for j in range(size):
            total = total * np.uint64(_MULTIPLIER) + h[j : j + n]
            plain += k[j : j + n] == 0
        typed = plain >= min(LITERALS, size)
        if not typed.all():
            bare = np.flatnonzero(~typed)
            exact = np.zeros(len(bare), np.uint64)
            for j in range(size):
                exact = exact * np.uint64(_MULTIPLIER) + literal[bare + j]
            total[bare] = exact
        return total ^ (total >> np.uint64(29)), typed

    def spell(self, k: np.ndarray, words: list[str], at: int, size: int, typed: bool) -> tuple[str, list[str]]:
        """The template of a window, and its slots (empty for plain words); a literal window has none."""
        kinds, plain = k[at : at + size], [plain_word(w).lower() for w in words[at : at + size]]
        if not typed:
            return " ".join(plain), [""] * size
        template = " ".join(_KINDS[x] or w for x, w in zip(kinds, plain, strict=True))
        return template, [w if x else "" for x, w in zip(kinds, plain, strict=True)]


def _counted(match: list) -> tuple[list[int], bool]:
    """The places of an alignment's windows that count, and whether a slot of theirs was changed."""
    match = sorted(match, key=lambda m: m["at"])
    same = {m["at"] for m in match if all(p["was"] == p["now"] for p in m["pairs"])}
    names = {(p["was"], p["now"]) for m in match for p in m["pairs"] if p["kind"] == _KINDS[2]}
    best: list[int] = []
    if len({was for was, _ in names}) == len(names) == len({now for _, now in names}):
        start, now_of, uses = 0, {}, Counter()
        for end, m in enumerate(match):
            values = {((p["kind"], p["was"]), p["now"]) for p in m["pairs"] if p["kind"] != _KINDS[2]}
            if len({was for was, _ in values}) < len(values):  # at odds with itself
                start, now_of, uses = end + 1, {}, Counter()
                continue
            while any(uses[was] and now_of[was] != now for was, now in values):
                for was in {(p["kind"], p["was"]) for p in match[start]["pairs"] if p["kind"] != _KINDS[2]}:
                    uses[was] -= 1
                start += 1
            for was, now in values:
                now_of[was] = now
                uses[was] += 1
            if end + 1 - start > len(best):
                best = [w["at"] for w in match[start : end + 1]]
    return sorted(same.union(best)), not same.issuperset(best)


@F.pandas_udf(StructType([StructField("places", ArrayType(IntegerType())), StructField("changed", BooleanType())]))
def counted_windows(matches: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counted(m) for m in matches], columns=["places", "changed"])


WINDOWS = "key string, id bigint, at int, size int, hash bigint, template string, slots array<string>, windows int"


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _emit(sizes_of: Callable[[int], list[int]], bitmap: np.ndarray | None):
    """A batch reader that gives the windows of each text; with a bitmap, those that pass it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            rows = []
            for key, doc, text in zip(batch["key"], batch["id"], batch["text"], strict=True):
                h, literal, k, words = templates.read(text)
                for size in sizes_of(len(h)):
                    hashes, typed = templates.windows(h, literal, k, size)
                    ok = np.ones(len(hashes), bool)
                    if bitmap is not None and len(hashes):
                        place = hashes >> np.uint64(64 - BITMAP_BITS)
                        ok &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at = np.flatnonzero(ok)
                    signed = _signed(hashes)
                    for i in at:
                        rows.append((key, doc, i, size, signed[i], *templates.spell(k, words, i, size, typed[i]), len(ok)))
                    if len(rows) > 20_000:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["key", "id", "at", "size", "hash", "template", "slots", "windows"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"id": "Int64", "at": "int32", "size": "int32", "hash": "int64", "windows": "int32"})


def _keyed(df: DataFrame, name: str, key) -> DataFrame:
    return df.select(key.cast("string").alias("key"), F.col(name).cast("bigint").alias("id"), text_of().alias("text"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of the benchmark; short items as one window."""

    def sizes(n: int) -> list[int]:
        return [min(n, WINDOW)] if n >= LITERALS else []

    keyed = _keyed(benchmark.dropDuplicates(["item_id", "text"]), "item_id", F.lit(0).cast("bigint"))
    return stage(keyed.mapInPandas(_emit(sizes, None), WINDOWS), "bench_windows")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which leading bits of a hash occur in the benchmark: 2 MB, whatever its size."""
    places = windows.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).cast("int").alias("p")).distinct()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[places.toPandas()["p"].to_numpy(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def links(docs: DataFrame, benchmark: DataFrame, row=None) -> DataFrame:
    """(row, doc_id, item_id) of all links, with windows covered and whether slots were changed."""
    items = benchmark_windows(benchmark)
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW values
    bitmap = _bitmap(items)

    def sizes(n: int) -> list[int]:
        return [s for s in lengths if s <= n]

    row = row if row is not None else F.monotonically_increasing_id()
    seen = _keyed(docs, "doc_id", row).mapInPandas(_emit(sizes, bitmap), WINDOWS)
    seen = seen.select("key", F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "hash", "template",
                       F.col("slots").alias("doc_slots"))
    theirs = items.select(F.col("id").alias("item_id"), "at", "hash", "template", "slots", "windows")
    met = seen.join(theirs, ["hash", "template"]).withColumn("shift", F.col("doc_at") - F.col("at"))
    pairs = F.filter(
        F.arrays_zip(
            F.split("template", " ").alias("kind"), F.col("slots").alias("was"), F.col("doc_slots").alias("now")
        ),
        lambda s: s["was"] != "",
    )
    # An alignment has at most one match per window of the item, so its lists are short.
    aligned = met.groupBy("key", "doc_id", "item_id", "shift").agg(
        F.collect_list(F.struct("at", pairs.alias("pairs"))).alias("matches"), F.max("windows").alias("windows")
    )
    fit = aligned.select("key", "doc_id", "item_id", "windows", counted_windows("matches").alias("fit"))
    fit = fit.select("key", "doc_id", "item_id", "windows", "fit.*")
    covered = (
        fit.select("key", "doc_id", "item_id", "windows", "changed", F.explode("places").alias("place"))
        .groupBy("key", "doc_id", "item_id")
        .agg(
            F.count_distinct("place").alias("matched"), F.max("windows").alias("windows"),
            F.min("changed").alias("changed"),
        )
    )
    enough = (F.col("matched") >= RUN_WINDOWS) | (F.col("matched") >= COVERAGE * F.col("windows"))
    return covered.where(enough)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per linked pair of document and item."""
    pairs = links(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("int").alias("windows_matched"), F.max("windows").alias("item_windows"),
        F.min("changed").alias("changed"),
    )
    return pairs.select(
        "doc_id", "item_id", "windows_matched", "item_windows",
        F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are linked to no item."""
    held = with_rows(docs, "decon_input")
    bad = stage(links(held, benchmark, F.col("_row")).select(F.col("key").alias("_row")).distinct(), "decon_rows")
    return held.join(bad, "_row", "left_anti").drop("_row")
