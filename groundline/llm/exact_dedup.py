"""Exact dedup by content sort (operator 8), DataFrame functions only.

Sampled splitters range-partition the rows by (head of the text, hash of the text, salt);
each partition is sorted externally by (head, hash, salt, text), so equal texts are
adjacent, and a window over that order compares neighbours in full and gives each run of
equal ones its row that stays and its size. The splitters sample a bounded head instead
of whole texts, so what the driver samples stays small.

The salt is 0, so that all copies of a text make one run, but for hot texts: those whose
hash has more copies than a quarter of a partition's rows. There are at most four of them
to a partition, so they are known by a broadcast; each is dealt into as many runs as it
has such quarters, and these runs alone meet again, by their full texts. SHA-256 is an
output column and, with the hash, the name by which rows of a hot text find their group.

Which row of a group stays is a parameter: the smallest or the largest doc_id.

Edge cases: null text counts as empty; a null doc_id stays only if its group has no
other (keep_id is null then); rows that repeat a doc_id each count in group_size and
share ``kept``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, parts, prepared

HEAD = 48
#: Hot is a text with more copies than a partition's rows by this; it goes to runs of about that many.
SHARE = 4


def sorted_runs(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, hash, text_sha256, hot; keep_rank (doc_id that stays) and n of the row's run after the content sort; lead: one row of each run, which has the text, too, if it is hot."""
    pick, odd = _picks(keep)
    n = parts(docs.sparkSession)
    rows = prepared(docs).withColumn("hash", F.xxhash64("text"))
    most = max(1, docs.count() // (SHARE * n))
    hot = rows.groupBy(F.col("hash").alias("hot_hash")).agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    hot = hot.select("hot_hash", F.ceil(F.col("copies") / most).alias("salts"))  # fewer than SHARE * n rows
    dealt = rows.join(F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left")
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("salts")), F.lit(0).cast("long"))
    dealt = dealt.select(
        "doc_id", "text", "hash", F.coalesce("doc_id", F.lit(odd)).alias("rank"), F.substring("text", 1, HEAD).alias("head"), F.col("salts").isNotNull().alias("hot"), salt.alias("salt"),
    ).repartitionByRange(n, "head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "salt", "text").orderBy("rank")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = dealt.select("doc_id", "hash", "hot", "text", pick("rank").over(whole).alias("keep_rank"), F.count("*").over(whole).alias("n"), (F.row_number().over(run) == 1).alias("lead"))
    return marked.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"), "hot", "keep_rank", "n", "lead", F.when(F.col("hot") & F.col("lead"), F.col("text")).alias("text"))


def _picks(keep: str) -> tuple:
    return {"smallest": (F.min, NULL_ID), "largest": (F.max, -NULL_ID - 1)}[keep]


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    pick, odd = _picks(keep)
    marked = cut(sorted_runs(docs, keep))
    again = marked.where("hot and lead").groupBy(F.col("hash").alias("g_hash"), "text").agg(F.first("text_sha256").alias("g_sha"), pick("keep_rank").alias("g_rank"), F.sum("n").alias("g_n"))
    # as many rows as there are hot texts
    again = F.broadcast(again.select("g_hash", "g_sha", "g_rank", "g_n"))
    rows = marked.join(again, F.col("hot") & (F.col("hash") == F.col("g_hash")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    keep_id = F.nullif(F.coalesce("g_rank", "keep_rank"), F.lit(odd))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("g_n", "n").alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
