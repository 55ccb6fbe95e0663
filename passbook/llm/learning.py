"""What the two classifiers share: labels, the training fold, and a bounded sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import is_held_out
from passbook.session import stage

#: Labelled rows that a model is fitted on at most: those whose id's hash is low.
TRAIN_ROWS = 20_000
_SPAN = 1 << 30


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold; null labels go, repeated ids count once."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).dropna()
    return known.where(~is_held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled_labels(labels: DataFrame, target: str, most: int = TRAIN_ROWS) -> DataFrame:
    """At most ``most`` training labels, the same ones on every run, as a stage table.

    Of more labels, those below a threshold of the id's hash, set four standard deviations
    under the bound; a threshold needs no sort and no task that sees all rows.
    """
    known = stage(training_labels(labels, target), f"labels_{target}")
    n = known.count()
    if n <= most:
        return known
    share = (most - 4 * math.sqrt(most)) / n
    low = F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)) < int(share * _SPAN)
    return stage(known.where(low).limit(most), f"sample_{target}")


def training_rows(docs: DataFrame, labels: DataFrame, target: str, value: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, value, label) of the sampled labels, one row per id: that of the least value.

    The sample is broadcast (its rows are bounded), so no document moves; ``value`` is
    worked out for sampled documents only.
    """
    sample = sampled_labels(labels, target, most)
    met = docs.join(F.broadcast(sample), "doc_id").select("doc_id", value.alias("value"), "label")
    return met.groupBy("doc_id", "label").agg(F.min("value").alias("value")).orderBy("doc_id")
