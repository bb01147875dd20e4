"""Connected components of links between long ids, by alternating large-star and small-star steps.

Every step is two aggregations and a join over the links, written to the shared folder;
nothing is gathered on the driver but a count and a checksum for each round. A node with
very many neighbours is a skewed join key, which adaptive execution splits; it only does so
where a join reads shuffles directly, so the minima that are joined are written first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one. ``links`` are read for the last time."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
    return cut(both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), links, least)


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these. ``links`` are read for the last time."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"))
    moved = down.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), links, least)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that isn't itself the smallest of its component.

    Edge cases: links of a node with itself say nothing, so a node that has no other isn't in the result; links may
    repeat, in either direction; a link with a null end is dropped; other columns are ignored; no links, no rows.
    """
    links = cut(links.where("u <> v").select("u", "v"))
    state = _state(links)
    while state[0]:
        links = _small_star(_large_star(links))
        state, last = _state(links), state
        if state == last:
            break
    return links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
