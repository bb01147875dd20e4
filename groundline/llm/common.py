"""Shared pieces of the training-data operators.

Input convention: a DataFrame with at least ``doc_id`` and ``text``. ``prepared`` keeps
only the columns an operator asks for, so extra columns (clashing names included) never
meet the operators' own ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of a null doc_id: after every real one.
NULL_ID = (1 << 63) - 1
#: Inside of the character class of white space that every contract here uses.
WS = "\\x20\\x09-\\x0D"


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session (so the cluster's owner) sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and all executors are threads of this process."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="groundline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends here, and a lost executor costs no rerun.

    ``spent``: tables of former cuts that nothing but ``df`` reads; they are deleted once it is written, all others when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    for x in spent:
        files, at = _place(spark, x._cut)
        files.delete(at, True)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepared(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the named columns only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in more])


def rank_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NULL_ID))


def word_count(text: Column) -> Column:
    """Runs of other characters than white space, by built-in functions."""
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, for kernels that hold Python values of a whole batch at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
