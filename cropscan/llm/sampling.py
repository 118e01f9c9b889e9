"""Bounded samples of labelled rows for the classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows taken for training, about. This alone bounds what the driver holds.
TRAIN_ROWS = 12_000


def training_labels(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y): labelled rows that are not held out, thinned by a hash of doc_id to about ``rows``.

    Null labels and null doc_ids are left out; of repeated doc_ids the smallest label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(draw("doc_id") < share)


def draw(*columns: str) -> Column:
    """A number in [0, 1) made of the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)
