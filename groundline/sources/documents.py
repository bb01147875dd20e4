"""Documents from driver values and from tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textops import string_keys, stringified, to_json
from ..schemas import DOCUMENTS


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return from_values(spark, [{"text": text, "id": "document_0"}])


def from_values(spark: SparkSession, documents: Iterable[dict | str]) -> DataFrame:
    """Objects keep their id (or none); plain values are texts and named by position. ``doc_seq`` is the position."""
    if isinstance(documents, (dict, str)):
        raise TypeError("documents must be a collection of documents")
    rows = []
    for i, d in enumerate(documents):
        if isinstance(d, dict):
            d = string_keys(d)
            rows.append((i, None if d.get("id") is None else stringified(d["id"]), stringified(d.get("text")), to_json(d.get("metadata") or {})))
        else:
            rows.append((i, f"document_{i}", stringified(d), "{}"))
    return spark.createDataFrame(rows, DOCUMENTS)


def from_table(table: DataFrame, seq: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """A table as documents: its key is doc_seq and, as text, id; other columns can be metadata."""
    meta = F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")
    return table.select(F.col(seq).cast("long").alias("doc_seq"), F.col(seq).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), meta.alias("metadata_json"))


def spread(docs: DataFrame) -> DataFrame:
    """Dealt to all cores if the scan gave fewer partitions (a small file is one); never at scale."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
