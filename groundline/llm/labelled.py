"""A bounded sample of labelled rows with their texts, for the operators that learn.

What reaches the driver is the features of at most ``most`` texts, not the texts.

Edge cases: a label without a document, a null label, and a null doc_id in either table are
left out; a doc_id that repeats counts once, with its smallest label and text; a null text
is an empty one; other columns are ignored; without labels or documents there is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the doc_id as text leaves 1 by 3; also rows without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label, bytes for at most ``most`` labelled documents that aren't held out, the same ones on every run.

    The sample of labels is bounded by ``most``, so it is broadcast; a doc_id that repeats counts once, with its
    smallest label and text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = prepared(docs).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("bytes"))
