import re
from itertools import permutations

from pyspark.sql import functions as F

from passbook.llm import audit

COLUMNS = "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"


def fails(doc_id, text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and least is not None and least < doc_id:
        out.add("E")
    return out


def slow(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = {}
    for doc_id, text, source in rows:
        parts.setdefault(source or "", []).append((doc_id, fails(doc_id, text or "", least.get(text or ""))))
    out = []
    for part, docs in parts.items():
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                lines.append([
                    part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone),
                    sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f,
                ])
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


def found(spark, path, labels, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.filter_audit(spark, path, labels, **how).collect())


def test_late_smaller_ids_are_retracted(spark, edge, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    files = [
        [(50, words, "a"), (51, words, "b"), (52, "SHOUT # this", "a"), (None, words, "a")],
        [(20, words, "b"), (20, words, "b"), (53, words, "c"), (54, None, None)],
        [(10, words, "c"), (20, words, "c"), (52, "SHOUT # this", "b"), (3, "", "a")],
        [(10, words, "a"), (11, "x " * 80, ""), (60, words + " ", "a"), (None, None, "a")],
    ]
    path, rows = str(tmp_path / "docs"), []
    labels = [(10, 1, 1), (20, 1, 0), (20, 0, 1), (50, 1, None), (52, None, 1), (None, 1, 1)]
    for part in files:
        df = spark.createDataFrame([(*r, 9, True) for r in part], "doc_id long, text string, source string, mask int, good boolean")
        df.coalesce(1).write.mode("append").parquet(path)
        rows += part
    extra = edge.select("doc_id", "text", "source").withColumn("mask", F.lit(1)).withColumn("good", F.lit(False))
    extra.repartition(3).write.mode("append").parquet(path)
    rows += [(r.doc_id, r.text, r.source) for r in edge.collect()]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = slow(rows, labels)
    for batches in (1, 3, 99):
        assert found(spark, path, given, batches=batches) == want
    assert any(r[9] for r in want)


def test_batches_take_back_what_they_said(spark):
    schema = "sha binary, part string, mask int, good boolean, toxic boolean, every long, least long, bear long"
    first = spark.createDataFrame([(b"t", "a", 2, True, False, 5, 50, 1)], schema)
    later = spark.createDataFrame([(b"t", "b", 2, False, False, 1, 7, 1)], schema)
    said = {(r.part, r.mask): r.n for r in audit.changes(first, None).collect()}
    assert said == {("a", 2): 1, ("a", 2 | 16): 4}
    taken = {(r.part, r.mask): r.n for r in audit.changes(later, first).collect()}
    assert taken == {("a", 2): -1, ("a", 2 | 16): 1, ("b", 2): 1, ("b", 2 | 16): 0}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    given = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert found(spark, f"{sf}/documents.parquet", labels) == slow([tuple(r) for r in docs], given)


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "none"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(spark, str(tmp_path / "none"), labels) == []
