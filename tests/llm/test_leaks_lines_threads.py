import random
import re
from itertools import combinations

from passbook.llm import decontaminate, lines, threads
from passbook.llm.common import table

ITEM = "In town a farmer named Karla has 14 sheep and buys 3 kg of corn for every animal that she keeps near the old mill"


def test_planted_items_are_found_and_no_others(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = {b.item_id: b.text.split() for b in bench.collect()}
    want = set()
    for d in docs.collect():
        text = " ".join((d.text or "").split())
        for i, words in items.items():
            if any(" ".join(words[k : k + 13]) in text for k in range(max(1, len(words) - 12))):
                want.add((d.doc_id, i))
    assert got == want


def test_slots(spark, edge, empty):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short")], "item_id long, text string")
    other = ITEM.replace("Karla", "Mira").replace("14", "250").replace("3 kg", "7 lbs")
    rows = [
        (1, "Before. " + ITEM + " After."), (2, "Before. " + other + " After."), (3, "Nothing of the sort is said here at all."),
        (4, "wolves " + ITEM.lower().replace("sheep", "cows").replace("animal", "beast").replace("keeps", "owns").replace("town", "city")),
        (5, None), (2, "Before. " + other + " After."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kind for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: "verbatim", 2: "reparameterised"}
    kept = decontaminate.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.keep_clean(edge, bench).count() == 12
    assert decontaminate.keep_clean(empty, bench).count() == 0 and decontaminate.keep_clean(edge, bench.limit(0)).count() == 12


def test_slots_must_be_consistent(spark):
    item = "first the boy Karl met Anna then he gave Karl a note and saw Anna again before Karl went home to see Anna"
    bad = item.replace("Karl a note", "Otto a note").replace("before Karl", "before Udo")
    docs = spark.createDataFrame([(1, item.replace("Karl", "Otto")), (2, bad)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_colliding_numbers_leave_the_rest_of_a_match(spark):
    pairs = "he paid 5 coins for the bread and the cheese and then 3 coins for the wine that was in the cellar"
    twice = "she gave 5 apples to the tall boy and later at noon gave 5 pears to the small girl who lived at the very end of the long road"
    rows = [
        (1, ITEM.replace("14 sheep", "3 sheep")), (2, pairs.replace("5", "4").replace("3", "4")),
        (3, twice.replace("5 apples", "4 apples").replace("5 pears", "7 pears")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, pairs), (3, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "reparameterised"}


def test_items_dense_in_numbers_are_found_verbatim(spark):
    item = "Let f(3) = 7, f(5) = 11 and f(9) = 19; find f(2) + f(4)"
    short = "Add 12, 47, 88 and Berta 63"
    rows = [(1, "Before. " + item + " After."), (2, "Before. " + item.replace("7", "8") + " After."), (3, "We say: " + short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got >= {(1, 1, "verbatim"), (3, 2, "verbatim")} and all(g[0] != 2 or g[2] == "verbatim" for g in got)


def normal(line):
    plain = re.sub(r"\d", "0", line.lower())
    return " ".join(w for w in re.split(r"[\W_]+", plain) if w)


def test_lines(spark, edge, empty):
    long = " ".join(f"quarterly figure{i} rises" for i in range(40))
    rows = [
        (2, "Header 12\n\nunique line about rivers and boats today\n" + long),
        (1, "header  13!\nother words entirely for the second document here"),
        (3, long.replace("figure7 ", "figures7 ") + "\n\nHEADER 99\nlast"),
        (4, None), (5, "\n\n"), (3, long.replace("figure7 ", "figures7 ") + "\n\nHEADER 99\nlast"),
    ]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].startswith("header  13!") and got[2] == "\nunique line about rivers and boats today\n" + long
    assert got[3] == "\nlast" and got[4] == "" and got[5] == "\n\n"
    assert lines.dedup_lines(edge).count() == 12 and lines.dedup_lines(empty).count() == 0


def test_short_lines_at_one_edit_are_all_linked(spark):
    words = "amber birch cedar dune ember fjord grove heath inlet".split()
    rows, want = [], {}
    for n in range(5, 10):
        base = [f"{w}{'x' * n}" for w in words[:n]]
        rows.append((n * 100, " ".join(base)))
        edits = [base[:i] + ["changed"] + base[i + 1 :] for i in range(n)]
        edits += [base[:i] + ["added"] + base[i:] for i in range(n + 1) if n < 9]
        rows += [(n * 100 + 1 + i, " ".join(e)) for i, e in enumerate(edits)]
        rows.append((n * 100 + 50, " ".join(["other", "things", *base[2:]])))
        want |= {d: int(d % 50 == 0) for d, _ in rows if d // 100 == n}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept_lines for r in lines.dedup_lines(docs).collect()} == want


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_longer_lines_are_linked_as_by_all_pairs(spark):
    """Random lines of 10 to 60 words with random edits, near and beyond the similarity."""
    rng = random.Random(7)
    words = ["a", "of", "the"] * 40 + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(200)]
    texts = []
    for n in [10, 11, 13, 14, 15, 19, 20, 24, 30, 45, 60] * 6:
        line = rng.choices(words, k=n)
        texts.append(line)
        for share in (0.05, 0.15, 0.2, 0.3):
            copy = list(line)
            for _ in range(max(1, int(share * n + 1e-9))):
                at, how = rng.randrange(len(copy)), rng.choice("sssdi")
                copy[at : at + (how != "i")] = [] if how == "d" else [rng.choice(words)]
            texts.append(copy)
    texts.append([*texts[-5][1:], "moved"])
    alike = {i: {i} for i in range(len(texts))}
    for i, j in combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        if alike[i] is not alike[j] and word_edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            alike[i] |= alike[j]
            for k in alike[j]:
                alike[k] = alike[i]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept_lines for r in lines.dedup_lines(docs).collect()}
    assert got == {i: int(i == min(alike[i])) for i in range(len(texts))}
    assert 60 < sum(got.values()) < 250


def test_crowded_pairs_of_words_are_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELL", 4)
    name = lambda *at: "".join("bcdfghklmnprst"[i // 7 % 14] + "aeiouyw"[i % 7] for i in at)
    base = [f"wordword{name(i)}" for i in range(20)]
    rows = [(i, " ".join([*base[:8], name(1, i), name(2, i), *base[10:14], name(3, i), *base[15:]])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:3], *(name(50 + i, j) for j in range(15))])) for i in range(10)] + rows[:5]
    got = {r.doc_id: r.kept_lines for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d == 0 or d >= 100) for d, _ in rows}


def test_exact_lines_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    seen, want = set(), {}
    for d in sorted(docs.collect(), key=lambda d: d.doc_id):
        kept = 0
        for line in (d.text or "").split("\n"):
            key = normal(line)
            kept += not key or key not in seen
            seen.add(key)
        want[d.doc_id] = kept
    got = {r.doc_id: r.kept_lines for r in lines.dedup_lines(docs).collect()}
    assert all(got[d] <= n for d, n in want.items())  # fuzzy links can only drop more
    assert sum(got.values()) >= 0.95 * sum(want.values())


def test_threads(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI lost it."), (1, 1, "assistant", "Look in the drawer."),
        (1, 2, "user", "> Look in  the DRAWER.\n>> where is the key?\nNot there."), (1, 3, None, "> I lost it.\nSince when?"),
        (1, 4, "user", "New topic"), (1, 5, "user", "> Not there.\nStill not."), (2, 0, "user", "> Look in the drawer.\nno origin"),
        (None, None, "user", None), (1, 4, "user", "New topic"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = threads.chat(chats).collect()
    assert len(got) == 9
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent for t in range(6)] == [None, None, 1, 0, None, 2]
    assert [by[1, t].thread for t in range(6)] == [0, 1, 1, 0, 4, 1] and by[1, 5].depth == 2
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.place)] == [0, 3, 1, 2, 5, 4, 4]
    assert by[1, 2].formatted == "<|user|>\nNot there." and by[1, 3].formatted == "<|unknown|>\nSince when?"
    assert by[2, 0].parent is None and by[2, 0].quoted_lines == 1
    assert threads.chat(chats.limit(0)).count() == 0


def test_wrapped_and_partial_quotes_are_linked(spark):
    long = "The boat leaves the harbour at noon. Bring warm clothes and a lamp, as the crossing takes most of the night."
    rows = [
        (1, 0, "user", long), (1, 1, "assistant", "How long does it take?"),
        (1, 2, "user", "> The boat leaves the\n> harbour at noon. Bring warm clothes\n> and a lamp, as the crossing takes\n> most of the night.\nFine."),
        (1, 3, "user", "> Bring warm clothes and a lamp\nWhy?"), (1, 4, "user", "> Fine.\n> Not that at all\nSo be it."),
        (1, 5, "user", "> The harbour leaves the boat\nNo such words."),
    ]
    got = threads.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent for r in got} == {0: None, 1: None, 2: 0, 3: 0, 4: 2, 5: None}
    assert {r.turn: r.quoted_lines for r in got} == {0: 0, 1: 0, 2: 4, 3: 1, 4: 2, 5: 1}
