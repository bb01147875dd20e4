"""Extraction over streams of documents: every step is per document, so rows are appended as they come, without a watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import extract
from ..schemas import DOCUMENTS
from ..sources import jsonl


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of documents, as they arrive in a folder."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(docs: DataFrame, model: Any, prompt_description: str, **options) -> DataFrame:
    return extract(docs, model, prompt_description, **options)


def write_lines(annotated: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """JSON lines, appended exactly once under the checkpoint."""
    lines = annotated.select(jsonl.line_column().alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
