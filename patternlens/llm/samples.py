"""Bounded training samples. Everything else about a classifier covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts).cast("int")


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of (id, ...) that come first by a hash of the id: the same ones on every run."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(n)


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): one row per id; null labels do not count, and among several the majority does (ties: 1)."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    return rows.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the sampled ids; ``ids`` is bounded by the sample's size, so it may be broadcast."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
