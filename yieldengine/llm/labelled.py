"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_label_per_id(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label (0 or 1): rows without an id or a label are ignored, of repeated ids the largest label holds."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    )


def first_by_hash(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows, the same ones at every run and partitioning: least hash of the id first."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def sampled(docs: DataFrame, ids: DataFrame, columns: list[Column]) -> DataFrame:
    """One document for each of a bounded table of ids; it has at most a sample's rows, so it may be broadcast.

    Of rows that repeat an id the first in order of the columns is taken, so the sample stays bounded however often.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*columns).alias("row")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", *[c for c in ids.columns if c != "doc_id"]).agg(F.min("row").alias("row"))
    return one.select(*ids.columns, "row.*")
