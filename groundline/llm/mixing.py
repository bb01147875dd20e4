"""Mixing sources to target weights (operator 4), DataFrame functions only.

Each source gets a target in words by water-filling: weight-proportional shares of the
total, none above ``MOST_EPOCHS`` times its source. A source's target is met by complete
epochs first, then by a fractional selection by Efraimidis-Spirakis sampling: a document
has the exponential key -ln(u) / w with u from the MD5 of its doc_id and its text's MD5,
and w its quality weight (the share of letters and spaces in the text, 1 to 2), documents
are sorted by key within the source, and sizes are prefix-summed up to the budget that is
left. The one document that crosses the budget is taken if that brings the source nearer
to its target.

Scale: a hot source's prefix sum is no single window. exp(-key) lies in (0, 1) with a
density of at most 2 (weights are 1 to 2), so equal cells of it are even buckets; their
number follows the source's number of documents. Sizes are summed by cell first, the
cells' sums are prefix-summed within blocks of cells and the blocks within the source,
and only then are documents summed within their cell. Texts are never shuffled. Rows
equal in doc_id, source and text are counted first and dealt out again in blocks, each
with a key of its own, so one row that recurs very often is no hot spot either.

Edge cases: a null text has size 0, and counts as equal to an empty one; a null source is
a source, ranked last; a null doc_id is hashed as the text 'null' with its text, so null
ones are spread; equal keys are ordered by doc_id, then text; rows equal in doc_id, source
and text get different keys, by their number among equals, so the mix can take some of
them more often than others, and ``mixed`` then deals as many copies to them; if all sizes
are 0, all targets are 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, cut, word_count

WEIGHTS, MOST_EPOCHS = (5.0, 2.0, 1.0), 3
CELL_ROWS, BLOCK_CELLS = 1000, 1000
#: Equal rows that are dealt out in one task.
EQUAL_ROWS = 1000
KEY = ("doc_id", "source", "th")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, n_docs, source_size, target from (source, size) and, if it is there, n, the number of such rows. One row per source; the windows run over sources, not documents."""
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    per = sizes.groupBy("source").agg(F.sum(n.cast("long")).alias("n_docs"), F.sum(F.col("size") * n).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    # sources fill up in the order of full_at; the level is found at the first that what is left does not fill (later ones give lower levels)
    rise = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    below, rest = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    target = F.least(F.col("weight") * F.col("level"), (most * F.col("source_size")).cast("double"))
    return per.select("source", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def quality_weight(text: Column) -> Column:
    """1 to 2: 1 and the share of letters and white space."""
    other = F.char_length(F.regexp_replace(text, rf"[\p{{L}}{WS}]+", ""))
    return F.when(F.char_length(text) > 0, 2 - other / F.char_length(text)).otherwise(F.lit(1.0))


def _bits(x: Column) -> Column:
    """48 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 12), 16, 10).cast("long")


def _text(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _equal_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, th (hash of the text), size, quality, bits (of the key) and n, for each group of rows equal in KEY."""
    text, doc_id = _text(docs), F.col("doc_id").cast("long")
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary")))
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("th"), word_count(text).alias("size"), quality_weight(text).alias("quality"), _bits(key).alias("bits"))
    return rows.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("size", "quality", "bits")], F.count("*").alias("n"))


def _dealt(groups: DataFrame) -> DataFrame:
    """Each group's rows again, with place: exp(-key) of the key -ln(u) / w, larger goes first."""
    n = F.col("n")
    block = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(EQUAL_ROWS).cast("long")))
    more = groups.where("n > 1").withColumn("block", block).repartition(*KEY, "block")
    more = more.withColumn("ordinal", F.explode(F.sequence("block", F.least(F.col("block") + EQUAL_ROWS, n) - 1))).drop("block")
    each = groups.where("n = 1").withColumn("ordinal", F.lit(0).cast("long")).union(more)
    bits = F.when(F.col("ordinal") == 0, F.col("bits")).otherwise(_bits(F.concat_ws(":", "bits", "ordinal")))
    return each.withColumn("place", F.pow((bits + 1) / float(1 << 48), 1 / F.col("quality"))).drop("bits", "quality", "n")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, th (hash of the text), size, source, source_size, target, times (how often the mix takes the document) and taken for each row."""
    groups = cut(_equal_rows(docs))
    targets = cut(source_targets(groups.select("source", "size", "n"), weights, most))
    rows = _dealt(groups)
    named = targets.withColumnRenamed("source", "s")
    each = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # cells ascend as the key does
    cells = F.ceil(F.col("n_docs") / CELL_ROWS)
    each = each.withColumn("cell", F.least(F.floor((1 - F.col("place")) * cells), cells - 1))
    each = each.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    each = each.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = each.groupBy("source", "cell").agg(F.sum("size").alias("n")).withColumn("block", F.floor(F.col("cell") / BLOCK_CELLS))
    blocks = sums.groupBy("source", "block").agg(F.sum("n").alias("m"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("m").over(before(Window.partitionBy("source").orderBy("block"))), F.lit(0)).alias("ahead_block"))
    b = blocks.select(F.col("source").alias("s"), F.col("block").alias("k"), "ahead_block")
    sums = sums.join(b, sums["source"].eqNullSafe(F.col("s")) & (sums["block"] == F.col("k"))).select(
        F.col("source").alias("cell_source"), F.col("cell").alias("cell_no"),
        (F.col("ahead_block") + F.coalesce(F.sum("n").over(before(Window.partitionBy("source", "block").orderBy("cell"))), F.lit(0))).alias("ahead"),
    )
    each = each.join(cut(sums), each["source"].eqNullSafe(F.col("cell_source")) & (each["cell"] == F.col("cell_no")))
    within = Window.partitionBy("source", "cell").orderBy(F.desc("place"), F.col("doc_id").asc_nulls_last(), "th", "ordinal")
    so_far = F.col("ahead") + F.coalesce(F.sum("size").over(before(within)), F.lit(0))
    each = each.withColumn("so_far", so_far)
    after, budget = F.col("so_far") + F.col("size"), F.col("budget")
    extra = (after <= budget) | ((F.col("so_far") < budget) & (after - budget < budget - F.col("so_far")))
    each = each.withColumn("times", F.least(F.lit(most), F.col("whole") + F.when(F.col("target") > 0, extra.cast("long")).otherwise(F.lit(0))).cast("long"))
    return each.select("doc_id", "th", "size", "source", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it; rows equal in doc_id, source and text share their copies as evenly as can be."""
    times = mix(docs, weights, most).groupBy(*KEY).agg(F.count("*").alias("equal"), F.sum("times").alias("copies"))
    times = cut(times.select(*[F.col(c).alias(f"taken_{c}") for c in KEY], "equal", "copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = {"doc_id": F.col("row.doc_id").cast("long"), "source": F.col("row.source").cast("string"), "th": F.xxhash64(_text(docs, "row.text"))}
    same = own["doc_id"].eqNullSafe(F.col("taken_doc_id")) & own["source"].eqNullSafe(F.col("taken_source")) & (own["th"] == F.col("taken_th"))
    out = rows.join(times.where("equal = 1 and copies > 0"), same).select("row", "copies")
    repeated = times.where("equal > 1")
    if not repeated.isEmpty():
        out = out.union(_shared(rows.join(repeated, same)))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _shared(rows: DataFrame) -> DataFrame:
    """row and its copies, for rows that share theirs (equal: number of rows, copies: of all): numbered within salts of about EQUAL_ROWS rows."""
    key = [f"taken_{c}" for c in KEY]
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("equal") / EQUAL_ROWS))
    rows = cut(rows.withColumn("salt", salt))  # so that a row never changes its salt
    sums = rows.groupBy(*key, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("salt").alias("of_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = F.col("salt") == F.col("of_salt")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    number = F.col("before") + F.row_number().over(Window.partitionBy(*key, "salt").orderBy("equal"))
    rows = rows.join(sums, same).withColumn("number", number)
    share = F.floor(F.col("copies") / F.col("equal")) + (F.col("number") <= F.col("copies") % F.col("equal")).cast("long")
    return rows.select("row", share.alias("copies")).where("copies > 0")
