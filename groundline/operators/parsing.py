"""Model outputs to extraction items: JSON or YAML, fenced or not."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FormatParsingError
from ..functions.textops import WS, string_keys, stringified, strip, to_json
from ..schemas import PARSED

FENCE = rf"```(?:json|yaml|yml)?[{WS}]*(.*?)```"
_FENCE = re.compile(FENCE, re.I | re.S)
_DEEPEST = 100


def payloads(output: str) -> list[str]:
    """Fenced blocks that aren't blank; the whole output if there are none."""
    return [x for x in map(strip, _FENCE.findall(output)) if x] or [output]


def payload_column(output: Column) -> Column:
    """The fenced blocks of :func:`payloads` as an array, by built-in functions."""
    blocks = F.transform(F.regexp_extract_all(output, F.lit("(?is)" + FENCE), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r\0")))
    return F.filter(blocks, lambda x: x != "")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _depth(value: Any) -> int:
    deepest, stack = 0, [(value, 1)]
    while stack:
        x, d = stack.pop()
        if isinstance(x, (dict, list)):
            deepest = max(deepest, d)
            stack += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return deepest


def from_json(payload: str) -> Any:
    try:
        value = json.loads(payload, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nesting is too deep") from e
    if _depth(value) > _DEEPEST:
        raise ValueError("nesting is too deep")
    return value


def _yaml_loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """Plain values only: no aliases, no dates."""

        def compose_node(self, parent, index):
            if self.check_event(yaml.AliasEvent):
                raise yaml.YAMLError("aliases are not allowed")
            return super().compose_node(parent, index)

    def date(loader, node):
        raise yaml.YAMLError("dates are not allowed")

    Loader.add_constructor("tag:yaml.org,2002:timestamp", date)
    Loader.add_constructor("tag:yaml.org,2002:str", lambda loader, node: node.value[1:] if node.style is None and re.fullmatch(r":[A-Za-z_]\w*", node.value) else node.value)
    return yaml, Loader


def from_yaml(payload: str) -> Any:
    try:
        yaml, loader = _yaml_loader()
    except ImportError as e:
        raise ValueError("YAML can't be read here") from e
    try:
        return yaml.load(payload, loader)  # noqa: S506  a safe loader
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(str(e)) from e


_READERS = {"json": (from_json,), "yaml": (from_yaml,), "auto": (from_json, from_yaml)}


def _decoded(output: str, fmt: str) -> Any:
    if fmt not in _READERS:
        raise FormatParsingError(f"unknown format: {fmt}")
    problems = []
    for payload in payloads(output):
        for read in _READERS[fmt]:
            try:
                value = read(payload)
            except ValueError as e:
                problems.append(str(e))
                continue
            if value is None or value is False or isinstance(value, (dict, list)):
                return value
            problems.append("payload is no object or array")
    raise FormatParsingError(f"unable to parse output: {'; '.join(problems)}")


def _truthy(*values: Any) -> Any:
    return next((v for v in values if v is not None and v is not False), None)


def _item(value: Any) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise FormatParsingError("extraction must be an object")
    x = string_keys(value)
    # false stands for itself where no alias is truthy
    text = _truthy(x.get("text"), x.get("extraction_text"))
    if text is None:
        text = x.get("extraction_text")
    if text is None:
        raise FormatParsingError("extraction text is required")
    attributes = _truthy(x.get("attributes"))
    if attributes is not None and not isinstance(attributes, dict):
        raise FormatParsingError("attributes must be an object")
    return {"extraction_class": _truthy(x.get("extraction_class"), x.get("class"), x.get("type")), "text": stringified(text), "description": x.get("description"), "attributes": attributes or {}, "group_id": x.get("group_id")}


def parse(output: str, fmt: str = "auto", strict: bool = True, schema: dict | None = None) -> list[dict[str, Any]]:
    """Items with the five fields; lenient parsing gives none where strict parsing raises FormatParsingError."""
    try:
        value = _decoded(output or "", fmt)
        if isinstance(value, dict):
            x = string_keys(value)
            value = _truthy(x.get("extractions"), x.get("data"), x.get("items"), x)
        items = [_item(v) for v in (value if isinstance(value, list) else [value] if value not in (None, False) else []) if v is not None]
        if schema:
            validate_schema(items, schema)
        return items
    except FormatParsingError:
        if strict:
            raise
        return []


_TYPES = {"string": lambda v: isinstance(v, str), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool)}


def validate_schema(items: list[dict[str, Any]], schema: dict) -> None:
    schema = string_keys(schema)
    required = schema.get("required") or []
    for i, item in enumerate(items):
        for name in [required] if isinstance(required, str) else required:
            if item.get(str(name)) in (None, "", [], {}):
                raise FormatParsingError(f"schema validation failed: extraction {i} missing {name}")
        for name, rule in (schema.get("properties") or {}).items():
            kind = rule.get("type")
            if item.get(name) is not None and kind in _TYPES and not _TYPES[kind](item[name]):
                raise FormatParsingError(f"schema validation failed: extraction {i} {name} must be {kind}")


def row_of(item: dict[str, Any]) -> dict[str, str | None]:
    """An item as a row: scalars as text, attributes as JSON."""
    text = lambda v: None if v is None else stringified(v)
    return {"extraction_class": text(item["extraction_class"]), "text": item["text"], "description": text(item["description"]), "attributes_json": to_json(item["attributes"]), "group_id": text(item["group_id"])}


def parsed(outputs: DataFrame, fmt: str = "auto", schema: dict | None = None, column: str = "output_text") -> DataFrame:
    """``outputs`` with ``items`` and ``parse_error``: no row is lost, what to do with errors is the caller's choice."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for outs in columns:
            rows = []
            for out in outs:
                try:
                    rows.append(([row_of(x) for x in parse(out, fmt, True, schema)], None))
                except FormatParsingError as e:
                    rows.append(([], str(e)))
            yield pd.DataFrame(rows, columns=["items", "parse_error"])

    return outputs.withColumn("_parsed", F.pandas_udf(run, PARSED)(column)).select(*outputs.columns, "_parsed.items", "_parsed.parse_error")


def json_items(output: Column) -> Column:
    """Items of a plain JSON output by built-in functions only: an object's extractions, data or items, an array, or the object itself."""
    v = F.try_parse_json(output)
    unwrapped = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$.extractions", "$.data", "$.items", "$")], F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))
    field = lambda x, *names: F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in names])
    return F.transform(unwrapped, lambda x: F.struct(field(x, "extraction_class", "class", "type").alias("extraction_class"), field(x, "text", "extraction_text").alias("text")))


def item_rows(parsed_outputs: DataFrame) -> DataFrame:
    """One row for each item, with its place in the output."""
    keep = [c for c in parsed_outputs.columns if c not in ("items", "parse_error")]
    return parsed_outputs.select(*keep, F.posexplode("items").alias("item_index", "item")).select(*keep, "item_index", "item.*")
