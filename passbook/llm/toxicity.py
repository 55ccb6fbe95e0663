"""Operator 3: toxicity by a factorization machine over hashed terms.

1. A bounded sample of labelled training rows (``TRAIN_ROWS``, those whose id's hash is
   low) becomes sets of word hashes (``2 ** HASH_BITS`` buckets) and length classes.
2. The machine (bias, linear weights and ``FACTORS`` factors for each bucket of the sample)
   is fitted on them. The factors give every pair of terms a weight of its own, so an
   insult with a group's name can weigh more than both alone.
3. All documents are hashed and scored in one pass; nothing is written or shuffled.

Cases: a null text counts as empty; an empty text has a length class only, and gets a score
from it; a null doc_id is never a training row; without labels every score is 0.5; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from passbook.llm.common import is_held_out, text_of
from passbook.llm.learning import TRAIN_ROWS, training_rows

HASH_BITS = 20
BUCKETS = 1 << HASH_BITS
FACTORS = 8
LENGTHS = 24
EPOCHS, BATCH, STEP, RIDGE = 40, 512, 0.01, 1e-4
#: A term takes part in the fit if enough of the sample's documents have it and its chi-square
#: is no chance, or if it is one of two whose pair tells that much more than both alone. Pairs
#: are counted among the terms that most toxic documents have, this many at most.
LEAST_DOCUMENTS, LEAST_CHI, PAIR_CHI, PAIR_TERMS = 3, 16.0, 40.0, 1024
#: Documents scored at a time.
SCORED = 1024
TOXIC_AT = 0.5
_WORD = re.compile(r"\w+")


def terms_of(text: str) -> np.ndarray:
    """The distinct word buckets of a text, and the bucket of its length class after them."""
    words = _WORD.findall(text.lower())
    found = {zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in set(words)}
    return np.asarray([*sorted(found), BUCKETS + min(len(words).bit_length(), LENGTHS - 1)], np.int32)


@F.pandas_udf(ArrayType(IntegerType()))
def hashed_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([terms_of(t) for t in texts], dtype=object)


def chi_square(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How far the documents with a mark (``pos`` toxic, ``neg`` not) are from chance."""
    a, b, p, n = pos.astype(float), neg.astype(float), float(n_pos), float(n_neg)
    rest = np.maximum(p + n - a - b, 1.0)
    return (p + n) * (a * (n - b) - b * (p - a)) ** 2 / (np.maximum(a + b, 1.0) * rest * max(p * n, 1.0))


def informative(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets that tell of the label alone or in pairs, and all length classes."""
    flat = np.concatenate(found)
    terms = np.flatnonzero(np.bincount(flat, minlength=BUCKETS + LENGTHS))
    number = np.full(BUCKETS + LENGTHS, -1, np.int32)
    number[terms] = np.arange(len(terms), dtype=np.int32)
    place = number[flat]
    label = np.repeat(y.astype(bool), [len(f) for f in found])
    pos = np.bincount(place[label], minlength=len(terms))
    neg = np.bincount(place, minlength=len(terms)) - pos
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    alone = chi_square(pos, neg, n_pos, n_neg)
    chosen = (terms >= BUCKETS) | ((pos + neg >= LEAST_DOCUMENTS) & (alone >= LEAST_CHI))
    often = np.flatnonzero((terms < BUCKETS) & (pos >= LEAST_DOCUMENTS))
    often = np.sort(often[np.lexsort((often, -pos[often]))][:PAIR_TERMS])
    where = np.full(len(terms), -1)
    where[often] = np.arange(len(often))
    together = np.zeros((2, len(often), len(often)), np.float32)
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    for kind in (0, 1):
        rows = np.flatnonzero(y == kind)
        for i in range(0, len(rows), SCORED):
            x = np.zeros((len(rows[i : i + SCORED]), len(often)), np.float32)
            for k, r in enumerate(rows[i : i + SCORED]):
                at = where[place[ends[r] : ends[r + 1]]]
                x[k, at[at >= 0]] = 1
            together[kind] += x.T @ x
    both = chi_square(together[1], together[0], n_pos, n_neg)
    more = (both >= np.maximum.outer(alone[often], alone[often]) + PAIR_CHI) & (together[1] >= LEAST_DOCUMENTS)
    np.fill_diagonal(more, False)
    chosen[often[more.any(axis=1)]] = True
    return terms[chosen].astype(np.int32)


class Machine:
    """A factorization machine over buckets of terms; every other bucket weighs nothing."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms, self.bias = terms, bias
        self.weight = np.zeros(len(terms))
        self.factor = np.random.default_rng(7).normal(0, 0.05, (len(terms), FACTORS))

    def known(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The terms that the machine knows, by their place, and the document of each."""
        flat = np.concatenate(found) if len(found) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(found), dtype=np.int32), np.fromiter(map(len, found), np.int64, len(found)))
        if not len(self.terms):
            return flat[:0], row[:0]
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        on = self.terms[at] == flat
        return at[on], row[on]

    def forward(self, at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of ``n`` documents, and the sums of their terms' factors.

        The weight of a pair of terms is the product of their factors; all pairs of a
        document together are half of the squared sum less the sum of squares.
        """
        factors = self.factor[at]
        ends = np.searchsorted(row, np.arange(n + 1))
        total = lambda x: np.diff(np.concatenate([np.zeros((1, FACTORS)), x.cumsum(0)])[ends], axis=0)
        met = total(factors)
        pairs = 0.5 * (met**2 - total(factors**2)).sum(1)
        return self.bias + np.bincount(row, self.weight[at], n) + pairs, met

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        out = []
        for i in range(0, len(found), SCORED):
            part = found[i : i + SCORED]
            raw = self.forward(*self.known(part), len(part))[0]
            out.append(1 / (1 + np.exp(-np.clip(raw, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(found: list[np.ndarray], y: np.ndarray) -> Machine:
    """Log loss by Adam over mini-batches, in an order that a fixed seed gives.

    A step moves the terms of its batch only.
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(0, np.int32), bias)
    model = Machine(informative(found, y), bias)
    at, row = model.known(found)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    params = np.concatenate([model.weight[:, None], model.factor], axis=1)
    model.weight, model.factor = params[:, 0], params[:, 1:]
    first, second = np.zeros_like(params), np.zeros_like(params)
    order, step = np.random.default_rng(11), 0
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = shuffled[i : i + BATCH]
            sizes = ends[rows + 1] - ends[rows]
            here = np.repeat(ends[rows] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
            batch_at, batch_row = at[here], np.repeat(np.arange(len(rows)), sizes)
            raw, met = model.forward(batch_at, batch_row, len(rows))
            off = 1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y[rows]
            touched, place = np.unique(batch_at, return_inverse=True)
            pull = np.concatenate([off[:, None], off[:, None] * met], axis=1)[batch_row]
            down = np.stack([np.bincount(place, c, len(touched)) for c in pull.T], axis=1)
            down[:, 1:] -= down[:, :1] * params[touched, 1:]
            g = down / len(rows) + RIDGE * params[touched]
            step += 1
            first[touched] = m = 0.9 * first[touched] + 0.1 * g
            second[touched] = v = 0.999 * second[touched] + 0.001 * g * g
            params[touched] -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.bias -= STEP * float(off.mean())
    return model


def scorer(model: Machine) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([terms_of(t) for t in texts]))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The columns of the contract: doc_id, held_out, score, predicted."""
    sample = training_rows(docs, labels, "toxic", hashed_terms(text_of()), most).toPandas()
    model = fit(sample["value"].to_list(), sample["label"].to_numpy())
    scored = docs.select("doc_id", is_held_out().alias("held_out"), scorer(model)(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))
