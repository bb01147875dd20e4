"""A training corpus from ``documents`` in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Edge cases, for every stage: null texts count as empty, but stay null where a stage keeps them; rows without a doc_id
and rows that repeat one take part like others (what is kept of them, each stage says); texts of any length are read
whole; columns of any name pass through all stages but the last, which returns pieces; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import line_dedup, mixing, packing, quality_classifier, simhash
from groundline.llm.common import cut, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; equal texts share their score, empty ones get the bias's. Without labels of both kinds all texts get one score."""
    return quality_classifier.accepted(docs, documents(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; rows equal in doc_id and text are one document. No row goes; null texts stay null."""
    out = line_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, texts that share 0.8 of their five-word shingles: of the smallest doc_id, a null one last. Texts without words are one group."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, and rows equal in doc_id, source and text share their copies."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows; each copy of a document is packed, an empty text as its end token alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mix), ("packing", pack)]

#: SQL can express neither the model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over all that the one before kept."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
