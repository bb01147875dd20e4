"""Highlighted HTML of annotated documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import IOFailure
from ..operators.alignment import Taken, grounded
from . import jsonl

#: Entities of the HTML that is written: fixed values.
_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
_TABLE = str.maketrans(_ENTITIES)

HEAD = """<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>Grounded extractions</title>
<style>
main { margin: 2rem auto; max-width: 60rem; font: 1rem/1.6 sans-serif; }
pre { white-space: pre-wrap; font: inherit; }
mark { background: gold; }
mark[data-status=fuzzy] { background: lightblue; }
.label { font-size: 80%; opacity: 0.7; padding-left: 0.25em; }
</style>
</head>
<body>
<main>
"""
TAIL = "</main>\n</body>\n</html>\n"


def escaped(value: Any) -> str:
    return str(value).translate(_TABLE)


def highlights(extractions: Iterable[dict]) -> list[dict]:
    """Grounded extractions by start (equal starts: as they come), without those that overlap one before."""
    taken, out = Taken(), []
    for x in sorted(filter(grounded, extractions), key=lambda x: x["char_interval"]["start_pos"]):
        span = (x["char_interval"]["start_pos"], x["char_interval"]["end_pos"])
        if not taken.overlaps(span):
            if span[0] < span[1]:
                taken.add(span)
            out.append(x)
    return out


#: Markup of marks and sections: fixed values.
MARK, SECTION = '<mark data-status="{}">{}<span class="label">{}</span></mark>', "<section>\n<h1>{}</h1>\n<pre>{}</pre>\n</section>\n"


def marked(text: str, extractions: Iterable[dict]) -> str:
    """The escaped text with marks; line ends within a mark are left out."""
    parts, at = [], 0
    for x in highlights(extractions):
        s, e = x["char_interval"]["start_pos"], x["char_interval"]["end_pos"]
        label = next((v for v in (x["description"], x["extraction_class"]) if v is not None), "extraction")
        mark = MARK.format(escaped(x["alignment_status"]), escaped(text[s:e]), escaped(label))
        parts += [escaped(text[at:s]), mark.replace("\n", "")]
        at = e
    return "".join([*parts, escaped(text[at:])])


def section(doc_id: str | None, text: str, extractions: Iterable[dict]) -> str:
    return SECTION.format(escaped("Document" if doc_id is None else doc_id), marked(text, extractions))


def sections(annotated: DataFrame) -> DataFrame:
    """doc_seq and the HTML section of each document, made where the documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("id", "text", "extractions")), strict=True)
            pages = pa.array([section(i, t or "", x or []) for i, t, x in given], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_seq"), pages], names=["doc_seq", "html"])

    return annotated.select("doc_seq", "id", "text", "extractions").mapInArrow(run, "doc_seq long, html string")


def _of_value(value: Row | dict) -> str:
    """The section of an annotated document that the driver has: a row, or an object as a JSON line holds it."""
    if isinstance(value, Row):
        value = value.asDict(recursive=True)
    if "document" in value or "metadata_json" not in value:
        value = jsonl.from_object(value)
    return section(value["id"], value["text"] or "", value["extractions"] or [])


def visualize(source: DataFrame | str | Row | dict | Iterable[Row | dict], spark: SparkSession | None = None) -> str:
    """A self-contained page of annotated documents, of one or several that the driver has, or of a file of JSON lines; for what a browser can show."""
    if isinstance(source, (Row, dict)):
        source = [source]
    if not isinstance(source, (str, DataFrame)):
        return HEAD + "".join(map(_of_value, source)) + TAIL
    if isinstance(source, str):
        source = jsonl.load(spark or SparkSession.active(), source)
        if source.isEmpty():
            raise IOFailure("no annotated documents found")
    body = [row["html"] for row in sections(source).orderBy("doc_seq").toLocalIterator()]
    return HEAD + "".join(body) + TAIL


def write_pages(annotated: DataFrame, path: str) -> str:
    """Sections as Parquet (doc_seq, html), for corpora: nothing passes the driver."""
    sections(annotated).write.mode("overwrite").parquet(path)
    return path
