import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from passbook.llm import quality
from passbook.llm.common import table, with_rows
from tests.llm.test_dedup import roots, slow_fingerprint


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    """Fingerprints at 4 bits, or five-word shingles at 0.8."""
    return (a[0] ^ b[0]).bit_count() <= 4 or 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1])


def shares(sizes):
    """Target words by source, as the contract says it."""
    total = sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_run_is_its_stages_by_hand(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    scored = quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    ids = sorted(r.doc_id for r in scored if r.score >= 0.3)
    seen = [(slow_fingerprint(docs[i].text), shingles(docs[i].text)) for i in ids]
    least = {}
    for i, g in zip(ids, roots(seen, near), strict=True):
        least.setdefault(g, i)
    items = [b.text.split() for b in table(spark, sf, "benchmark").collect()]

    def leaks(text):
        flat = " ".join(text.split())
        return any(" ".join(w[k : k + 13]) in flat for w in items for k in range(max(1, len(w) - 12)))

    clean = [i for i in sorted(least.values()) if not leaks(docs[i].text)]
    size = {i: len(docs[i].text.encode().split()) for i in clean}
    by_source = Counter()
    for i in clean:
        by_source[docs[i].source] += size[i]
    want = Counter()
    for s, target in shares(by_source).items():
        stream = sorted((i for i in clean if docs[i].source == s), key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest())
        left = int(target + 0.5)
        while left > 0:
            for i in stream:
                if left > 0 and size[i]:
                    want[i, min(left, size[i])] += 1
                    left -= min(left, size[i])
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, len(r.text.encode().split())) for r in got) == want
    for r in got:
        draws = [hashlib.md5(f"{r.doc_id}|{s}".encode()).hexdigest()[:13] for s in range(8)]
        assert r.shard == draws.index(max(draws))


def test_stages_take_edges(spark, sf, edge, empty):
    for docs in (edge, empty):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, sf)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= 3 * docs.count()


def test_rows_have_steady_names(spark, sf, edge):
    docs = table(spark, sf, "documents")
    once, again = (with_rows(docs, "x").select("_row", "doc_id").collect() for _ in range(2))
    assert {tuple(r) for r in once} == {tuple(r) for r in again} and len({r._row for r in once}) == len(once)
    assert "Exchange" not in with_rows(docs, "x")._jdf.queryExecution().toString()
    copied = with_rows(edge, "x")
    assert len({r._row for r in copied.collect()}) == 12 and {r._row for r in copied.collect()} == {r._row for r in copied.collect()}
    with pytest.raises(ValueError, match="reserved"):
        with_rows(copied, "x")
