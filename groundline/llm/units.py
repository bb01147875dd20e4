"""Common part of line dedup and substring dedup.

Rows are named by (id, th): the doc_id (null: the last rank) and a hash of the text, so
rows that repeat a doc_id with different texts stay apart, and exact repeats of a row,
whose results are the same, share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, rank_of


def trimmed(x: Column) -> Column:
    """White space of the contracts (space, \\t to \\r) off both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(docs: DataFrame) -> DataFrame:
    return prepared(docs).select("doc_id", "text", rank_of(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("th"))


def digest(key: Column) -> list[Column]:
    """128 bits of a key, as two columns a and b."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def keep_bitmap(n: Column, dropped: Column) -> Column:
    """A keep bitmap of n units as its runs: structs of the first unit and the number of units, one before each dropped unit and one after the last. ``dropped`` ascends."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n.cast("int")))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    return F.filter(runs, lambda r: r["n"] > 0)


def kept_units(units: Column, bitmap: Column) -> Column:
    """The units that a bitmap keeps, in order; linear in the units."""
    return F.flatten(F.transform(bitmap, lambda r: F.slice(units, r["first"] + 1, r["n"])))
