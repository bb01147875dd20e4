"""Line dedup (operator 9), DataFrame functions only.

Every line's key (trimmed, A-Z lowered) is hashed to 128 bits. The hashes are
range-partitioned by (hash, document) with sampled splitters and sorted by document and
position within, so a line that a third of all documents have spans partitions. The
sorted stream marks each document's first occurrence of a key; partial counts of these
give the number of documents of each key (and, if asked for, its first occurrence of all).
Keys that recur often enough go back to the documents as positions, which become run-length coded keep bitmaps: no text is grouped
or sorted, and it is joined with its bitmap only where the result asks for it.

Edge cases: a null or empty text is one empty line, and an empty key is never dropped
(``min_chars`` 1); a null doc_id is a document like others; rows equal in doc_id and
text count as one document and each get the result; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, rank_of
from .units import ascii_lower, digest, keep_bitmap, kept_units, named, trimmed


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(trimmed(line))


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """id, th, dropped: ascending positions of the lines that go; only for documents that lose any.

    ``keep_first``: of each key, the first line of the document with the smallest doc_id stays.
    """
    lines = named(docs).select("id", "th", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    lines = cut(lines.where(F.char_length("key") >= min_chars).select(*digest(F.col("key")), "id", "th", "pos"))  # else sampling the splitters would split all texts, too
    dealt = lines.repartitionByRange(parts(docs.sparkSession), "a", "b", "id", "th")
    stream = Window.partitionBy("a", "b", "id", "th").orderBy("pos")
    marked = cut(dealt.withColumn("first", F.row_number().over(stream) == 1), lines)
    place = F.struct("id", "th", "pos")
    often = marked.where("first").groupBy("a", "b").agg(F.count("*").alias("n_docs"), *[F.min(place).alias("earliest")] * keep_first)
    often = cut(often.where(F.col("n_docs") >= min_docs).drop("n_docs"))
    lost = marked.join(often, ["a", "b"])
    if keep_first:
        lost = lost.where(place != F.col("earliest"))
    return lost.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, id, th, text, n_lines, n_dropped and the keep bitmap of each row."""
    lost = dropped_lines(docs, min_docs, min_chars, keep_first)
    rows = named(docs).join(lost, ["id", "th"], "left")
    none = F.array().cast("array<int>")
    n = F.size(lines_of(F.col("text")))
    return rows.select(
        "doc_id", "id", "th", "text", n.cast("long").alias("n_lines"), F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"),
        keep_bitmap(n, F.coalesce("dropped", none)).alias("bitmap"),
    )


def kept_text(text: Column, bitmap: Column) -> Column:
    return F.array_join(kept_units(lines_of(text), bitmap), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays."""
    out = line_bitmaps(docs, min_docs, min_chars, keep_first)
    return out.select("doc_id", "n_lines", "n_dropped", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept_text(F.col("text"), F.col("bitmap"))).alias("text"))


def cleaned(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs`` with all their columns, texts without the dropped lines."""
    lost = dropped_lines(docs, min_docs, min_chars)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", rank_of(F.col("row.doc_id").cast("long")).alias("id"), F.xxhash64(text).alias("th")).join(lost, ["id", "th"], "left")
    bitmap = keep_bitmap(F.size(lines_of(text)), F.col("dropped"))
    new = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept_text(text, bitmap))
    return rows.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
