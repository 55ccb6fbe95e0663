import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from passbook.llm import spelling


def one_edit(a, b):
    """By definition: one replaced, inserted or deleted code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def found(docs):
    return sorted(
        tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    )


def test_against_all_pairs(spark, edge):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abÀé"), int(n))) for n in rng.integers(4, 8, 400)]
    rows = [(1000 + i, " ".join(words[int(k) % 400] for k in rng.zipf(1.3, 90))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    given = [(r.doc_id, r.text if r.doc_id != 9 else "") for r in docs.collect()]
    want = slow(given)
    assert len(want) > 100 and any(w[3] for w in want) and any(w[5] != w[0] and w[5] != w[3] for w in want)
    assert found(docs) == want


def test_all_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == slow([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_long_words_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    word = "".join(chr(97 + i * i % 26) for i in range(3000))
    border = "".join(chr(97 + i * 7 % 26) for i in range(64))
    texts = [word] * 9 + [word[:1500] + word[1501:]] * 4 + [word + "q"] * 4 + ["q" + word] * 4
    texts += [border] * 8 + [border + "z"] * 4 + [border[:-1]] * 4
    rows = [(i * 31 + 1, t) for i, t in enumerate(texts)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == slow(rows) and {len(w[0]) for w in got} >= {2999, 3000, 3001, 63, 64, 65}


def test_rotations_meet_once():
    keys = Counter(k for k, kind in spelling.rotations("aabb") if kind == spelling.SKIPS)
    assert keys == {"abb$": 1, "b$aa": 1}
    assert {k for k, kind in spelling.rotations("abb") if kind == spelling.WHOLE} == {"abb$", "bb$a", "b$ab", "$abb"}


def test_nothing(spark, empty):
    assert spelling.variants(empty).count() == 0
    none = spark.createDataFrame([(None, None), (1, ""), (2, "12 34")], "doc_id long, text string")
    out = spelling.variants(none.withColumn("word", F.lit("x")).withColumn("id", F.lit(1)))
    assert out.count() == 0 and out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
