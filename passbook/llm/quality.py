"""Operator 6: quality by histogram gradient-boosted trees over document statistics.

Each text becomes ``FEATURES`` (shares of byte classes, word and line repetition, lengths).
The trees are fitted on a bounded sample of at most ``TRAIN_ROWS`` labelled rows (those
whose id's hash is low) and flattened into three arrays (feature, threshold, value);
scoring walks all trees of all rows of a batch at once, one level at a time.

Cases: a null text counts as empty, and empty texts get a score like any other; a null
doc_id is never a training row; without labels every score is 0.5; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from passbook.llm.common import is_held_out, text_of
from passbook.llm.learning import TRAIN_ROWS, training_rows

KEEP_AT = 0.3
FEATURES = [
    "log_bytes", "letter", "upper", "digit", "space", "newline", "stop", "symbol", "pipe", "bang",
    "high_byte", "log_words", "word_length", "distinct_words", "top_word", "repeats", "lines",
    "distinct_lines", "line_words", "long_words", "shouted",
]
BINS, DEPTH, TREES, RATE, RIDGE, LEAST_HESSIAN = 64, 4, 100, 0.1, 1.0, 2.0


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT, _STOP = _class(b"0123456789"), _class(b".,;:?'\"()-")
_SYMBOL = _class(b"#$%&*@^~=+<>{}[]\\/_`|!")


def statistics(text: str) -> list[float]:
    """The ``FEATURES`` of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), *(counts[c].sum() / n for c in (_LETTER, _UPPER, _DIGIT)), counts[32] / n,
        counts[10] / n, counts[_STOP].sum() / n, counts[_SYMBOL].sum() / n, counts[124] / n, counts[33] / n,
        counts[128:].sum() / n, np.log1p(len(words)), sum(map(len, words)) / m, len(tally) / m,
        max(tally.values(), default=0) / m, repeats / m, len(lines) / m, len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1), sum(len(w) > 20 for w in tally) / m, sum(map(bytes.isupper, tally)) / max(len(tally), 1),
    ]


@F.pandas_udf(ArrayType(FloatType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(statistics(t), np.float32) for t in texts], dtype=object)


class Trees:
    """Boosted trees as flat arrays; nodes of a tree are numbered as in a heap."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with the log loss on binned features, one level of all nodes at a time."""
    inner, size = (1 << DEPTH) - 1, (1 << (DEPTH + 1)) - 1
    feature = np.zeros((TREES, size), np.int32)
    limit = np.full((TREES, size), np.inf, np.float32)
    value = np.zeros((TREES, size))
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature, limit, value)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T, strict=True)]).astype(np.int64)
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            for f, q in enumerate(cuts):
                cell = (at - first) * BINS + binned[f]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = 0
                gain[:, len(q):] = 0
                cut = gain.argmax(1)
                for n in np.flatnonzero(gain[np.arange(width), cut] > best + 1e-9):
                    best[n] = gain[n, cut[n]]
                    feature[t, first + n], limit[t, first + n] = f, q[cut[n]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > limit[t, at])
        g = np.bincount(at - inner, grad, inner + 1)
        h = np.bincount(at - inner, hess, inner + 1)
        value[t, inner:] = -RATE * g / (h + RIDGE)
        raw += value[t, at]
    return Trees(base, feature, limit, value)


def scorer(model: Trees) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_list()))) if len(f) else pd.Series([], dtype="float64")

    return score


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Trees from the statistics of a bounded sample of the labels outside the held-out fold."""
    sample = training_rows(docs, labels, "quality", features(text_of()), most).toPandas()
    x = np.stack(sample["value"].to_list()) if len(sample) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, sample["label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the contract: doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels))(features(text_of()))
    scored = docs.select("doc_id", is_held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The documents whose score reaches ``at``: one pass, nothing is shuffled or written."""
    return docs.where(scorer(train(docs, labels))(features(text_of())) >= at)
