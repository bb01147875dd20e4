"""Merging the extractions of chunks and passes: first of each kind wins, then greedy non-overlap, in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import Taken, grounded

KEY = ("start_pos", "end_pos", "text", "description", "extraction_class")


def merge(extractions: list[dict], allow_overlaps: bool = False) -> list[dict]:
    """One document's extractions in order, without repeats and without grounded ones that overlap an earlier kept one."""
    seen, taken, out = set(), Taken(), []
    for x in extractions:
        span = x["char_interval"]
        key = (x["document_id"], *((span["start_pos"], span["end_pos"]) if span else (None, None)), x["text"], x["description"], x["extraction_class"])
        if key in seen:
            continue
        seen.add(key)
        if grounded(x) and not allow_overlaps:
            place = (span["start_pos"], span["end_pos"])
            if taken.overlaps(place):
                continue
            if place[0] < place[1]:
                taken.add(place)
        out.append(x)
    return out


def first_of_each(rows: DataFrame, key: str = "doc_seq", order: str = "seq") -> DataFrame:
    """The first row, by ``order``, of each (document, interval, text, description, class); nulls are equal."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, *KEY).orderBy(order))).where("_n = 1").drop("_n")


def _kept(table: pa.Table, order: str) -> pa.Table:
    table = table.sort_by([(order, "ascending"), ("start_pos", "ascending"), ("end_pos", "ascending")])
    taken, keep = Taken(), []
    for s, e in zip(table.column("start_pos").to_pylist(), table.column("end_pos").to_pylist(), strict=True):
        clash = s is not None and e is not None and taken.overlaps((s, e))
        keep.append(not clash)
        if not clash and s is not None and e is not None and s < e:
            taken.add((s, e))
    return table.filter(pa.array(keep, pa.bool_()))


def non_overlapping(rows: DataFrame, key: str = "doc_seq", order: str = "seq") -> DataFrame:
    """Rows (key, order, start_pos, end_pos, ...) that overlap no row of their document kept before, in order; rows without an interval stay.

    What a row meets depends on all before it, so a document's rows are sorted and scanned in one task (n log n, in
    Arrow memory): what bounds a task is the largest document's number of rows, not the corpus.
    """
    return rows.groupBy(key).applyInArrow(lambda table: _kept(table, order), rows.schema).select(key, order, *(c for c in rows.columns if c not in (key, order)))


def regrouped(docs: DataFrame, rows: DataFrame, key: str = "doc_seq", order: str = "seq") -> DataFrame:
    """Each document with its rows in order, documents without any too; a document with its rows is one row, that is its bound."""
    fields = [order, *(c for c in rows.columns if c not in (key, order))]
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("extractions"))
    out = docs.join(gathered, key, "left")
    return out.withColumn("extractions", F.coalesce("extractions", F.array().cast(out.schema["extractions"].dataType)))
