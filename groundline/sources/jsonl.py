"""Annotated documents as JSON lines: one object per document, all keys, nulls included."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IOFailure
from ..functions.textops import BLANKS, string_keys, stringified, strip, to_json
from ..schemas import ANNOTATED


def _first_key(value: dict, *names: str) -> Any:
    """The value of the first key that is there, even if it is null."""
    return next((value[n] for n in names if n in value), None)


def _interval(value: Any) -> dict | None:
    if value is None:
        return None
    return {"start_pos": int(value["start_pos"]), "end_pos": int(value["end_pos"])}


def _text(value: Any) -> str | None:
    return None if value is None else stringified(value)


def from_object(value: dict) -> dict:
    """An annotated document from its JSON object; the flat form without ``document`` is read too."""
    value = string_keys(value)
    doc = value["document"] if isinstance(value.get("document"), dict) else value
    extractions = []
    for x in value.get("extractions") or []:
        index = x.get("extraction_index")
        status = x.get("alignment_status") or "ungrounded"
        if status not in ("exact", "fuzzy", "ungrounded", "overlap", "error"):
            raise ValueError(f"unknown alignment status: {status}")
        extractions.append(
            {
                "extraction_class": _text(_first_key(x, "extraction_class", "class", "type")), "text": stringified(_first_key(x, "text", "extraction_text")), "description": _text(x.get("description")),
                "attributes_json": to_json(x.get("attributes") or {}), "char_interval": _interval(x.get("char_interval")), "token_interval": _interval(x.get("token_interval")),
                "alignment_status": status, "extraction_index": None if index is None else int(index), "group_id": _text(x.get("group_id")), "document_id": _text(x.get("document_id")),
            }
        )
    return {"id": _text(doc.get("id")), "text": stringified(doc.get("text")), "metadata_json": to_json(doc.get("metadata") or {}), "extractions": extractions}


def to_object(row: Any) -> dict:
    """The JSON object of a row of annotated documents."""
    span = lambda v: None if v is None else {"start_pos": v["start_pos"], "end_pos": v["end_pos"]}
    return {
        "document": {"id": row["id"], "text": row["text"], "metadata": json.loads(row["metadata_json"] or "{}")},
        "extractions": [
            {
                "extraction_class": x["extraction_class"], "text": x["text"], "description": x["description"], "attributes": json.loads(x["attributes_json"] or "{}"),
                "char_interval": span(x["char_interval"]), "token_interval": span(x["token_interval"]), "alignment_status": x["alignment_status"],
                "extraction_index": x["extraction_index"], "group_id": x["group_id"], "document_id": x["document_id"],
            }
            for x in row["extractions"] or []
        ],
    }


def line_column() -> Column:
    """The JSON line of annotated documents, by built-in functions; stored JSON goes in as it is."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})

    def value(c: Column) -> Column:  # {"v":...} without its wrapping
        q = quoted(c)
        return F.substring(q, 6, F.char_length(q) - 6)

    def extraction(x: Column) -> Column:
        parts = []
        for name in ("extraction_class", "text", "description", "attributes", "char_interval", "token_interval", "alignment_status", "extraction_index", "group_id", "document_id"):
            v = F.coalesce(x["attributes_json"], F.lit("{}")) if name == "attributes" else value(x[name])
            parts += [F.lit(f'{"," if parts else "{"}"{name}":'), v]
        return F.concat(*parts, F.lit("}"))

    body = F.array_join(F.transform("extractions", extraction), ",")
    return F.concat(F.lit('{"document":{"id":'), value(F.col("id")), F.lit(',"text":'), value(F.col("text")), F.lit(',"metadata":'), F.coalesce("metadata_json", F.lit("{}")), F.lit('},"extractions":['), F.coalesce(body, F.lit("")), F.lit("]}"))


def save(annotated: DataFrame, path: str) -> str:
    """A folder of JSON lines, overwritten; each task writes its own file."""
    try:
        annotated.select(line_column().alias("value")).write.mode("overwrite").text(path)
    except PySparkException as e:
        raise IOFailure(f"could not write {path}: {e}") from e
    return path


def save_file(annotated: DataFrame, path: str) -> str:
    """One local file, in order of doc_seq; rows stream through the driver partition by partition."""
    try:
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            for row in annotated.orderBy("doc_seq").toLocalIterator():
                f.write(json.dumps(to_object(row.asDict(recursive=True)), ensure_ascii=False) + "\n")
    except OSError as e:
        raise IOFailure(f"could not write {path}: {e}") from e
    return path


def load(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Annotated documents of a file or folder; blank lines are skipped.

    doc_seq is the line's place: partition and row, ascending in the order of the files. ``check``: a line that isn't
    JSON fails the load at once, by one native pass that makes no documents of them; a line with other faults (or any,
    without the check) fails what reads it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seq, line in zip(frame["doc_seq"], frame["value"], strict=True):
                if strip(line):
                    rows.append({"doc_seq": seq, **from_object(json.loads(line))})
            yield pd.DataFrame(rows, columns=ANNOTATED.names)

    try:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_seq"), "value")
        if check:
            blank = F.btrim("value", F.lit(BLANKS)) == ""
            bad = lines.where(~blank & F.try_parse_json("value").isNull()).select(F.substring("value", 1, 80)).limit(1).collect()
            if bad:
                raise IOFailure(f"could not read {path}: a line is no JSON: {bad[0][0]}")
        return lines.mapInPandas(run, ANNOTATED)
    except PySparkException as e:
        raise IOFailure(f"could not read {path}: {e}") from e
