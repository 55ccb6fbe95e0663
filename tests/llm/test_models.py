import numpy as np
import pandas as pd

from passbook.llm import learning, quality, tokens, toxicity
from passbook.llm.common import table

BIG = "/root/testdata/sf0.1"


def auc(score, label):
    ranks = pd.Series(score).rank().to_numpy()
    pos = label.sum()
    return (ranks[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_held_out_accuracy(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    truth = labels.toPandas()
    for scores, target, least in (
        (quality.quality_scores(docs, labels), "quality", 0.95), (toxicity.toxicity_scores(docs, labels), "toxic", 0.9),
    ):
        got = scores.toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all()
        held = got[got.held_out].merge(truth, on="doc_id")
        assert auc(held.score, held[target].to_numpy()) > least


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert len(scores(edge, labels).where("score between 0 and 1").collect()) == 12
        assert {r.score for r in scores(edge, none).collect()} == {0.5}
        assert scores(empty, labels).count() == 0
    assert quality.keep_good(edge, none).columns == edge.columns and quality.keep_good(edge, none).count() == 12


def test_factors_learn_pairs():
    rng = np.random.default_rng(1)
    found, y = [], []
    for _ in range(3000):  # toxic only if both words are there: no linear weight can say so
        a, b = rng.integers(0, 2, 2)
        found.append(np.array([x for x, on in ((5, a), (9, b)) if on] + [toxicity.BUCKETS], np.int32))
        y.append(int(a and b))
    model = toxicity.fit(found, np.array(y))
    assert ((model.score(found) >= 0.5) == np.array(y)).mean() == 1


def test_token_counts_are_the_tokenizers(spark, sf, edge, empty):
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers  # noqa: F401

    vocabulary = tokens.read_vocabulary()
    pieces = [("<unk>", 0.0), *vocabulary]
    plain = Tokenizer(models.Unigram(pieces, unk_id=0))
    least = min(s for _, s in vocabulary)
    assert all(s <= 0 for _, s in vocabulary) and least - 10 == tokens.Counter(vocabulary).unknown
    counter = tokens.Counter(vocabulary)
    texts = [r.text or "" for r in table(spark, sf, "documents").limit(60).collect()]
    texts += ["", " ", "a  b   c", "no-break here", "日本語 😀 text", "x" * 300, "tabs\tand\nlines\n\n end ", "▁mark ▁ kept"]
    for t in texts:
        want = 0
        if t:
            for piece in plain.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).tokens:
                known = plain.token_to_id(piece)
                want += 1 if known else len(piece.encode())
        assert counter.count(t)[0] == want, t[:80]
    got = tokens.token_counts(edge).collect()
    assert len(got) == 12 and {r.tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert tokens.token_counts(empty).count() == 0


def test_words_that_say_nothing_alone_are_kept_for_their_pair():
    rng = np.random.default_rng(2)
    found, y = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        noise = rng.choice(500, 20, replace=False) + 1000
        found.append(np.array([*([5] if a else []), *([9] if b else []), *np.sort(noise), toxicity.BUCKETS], np.int32))
        y.append(int(a == b))
    chosen = toxicity.informative(found, np.array(y))
    assert {5, 9, toxicity.BUCKETS} <= set(chosen) and len(chosen) < 20
    model = toxicity.fit(found, np.array(y))
    assert ((model.score(found) >= 0.5) == np.array(y)).mean() > 0.99


def test_the_machine_is_its_pair_sums():
    rng = np.random.default_rng(3)
    found = [np.unique(rng.integers(0, 40, n)).astype(np.int32) for n in (1, 5, 12, 30)]
    model = toxicity.Machine(np.arange(0, 40, 2), 0.3)
    model.weight[:] = rng.normal(size=20)
    for f, got in zip(found, model.score(found), strict=True):
        at = [int(t) // 2 for t in f if t % 2 == 0]
        raw = 0.3 + sum(model.weight[i] for i in at)
        raw += sum(model.factor[i] @ model.factor[j] for n, i in enumerate(at) for j in at[:n])
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12


def test_trees_are_walked_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        raw = model.base
        for t in range(len(model.feature)):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[model.feature[t, at]] > model.limit[t, at] else 1)
            raw += model.value[t, at]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97


def test_the_sample_of_labels_is_bounded_and_steady(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    labels = labels.unionByName(labels)
    got = [sorted(map(tuple, learning.sampled_labels(labels, "toxic", 900).collect())) for _ in range(2)]
    assert got[0] == got[1] and 600 < len(got[0]) <= 900 and len({d for d, _ in got[0]}) == len(got[0])
    assert learning.sampled_labels(labels, "toxic").count() == learning.training_labels(labels, "toxic").count()
