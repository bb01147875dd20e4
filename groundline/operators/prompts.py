"""Prompts as columns, and the check of few-shot examples."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PromptValidationError
from ..functions.textops import string_keys, stringified, strip

#: Parts of a prompt that models are tuned to: fixed values.
TASK, CONTEXT, TEXT = "Task: ", "Additional context: ", "Text:\n"
BEFORE, AFTER = "Context before:\n", "Context after:\n"
CONTRACT = 'Return JSON with an "extractions" array. Each extraction must include "text", and may include "extraction_class", "description", "attributes", and "group_id".'

#: Fields of an example's extraction that a prompt shows.
SHOWN = ("extraction_class", "text", "description", "attributes", "group_id")


@dataclass(frozen=True)
class Example:
    """A few-shot example: a text and the extractions it should give."""

    text: str
    extractions: list[dict[str, Any]] = field(default_factory=list)

    @staticmethod
    def of(value: Example | dict) -> Example:
        if isinstance(value, Example):
            return Example(value.text, [string_keys(x) for x in value.extractions])
        value = string_keys(value)
        return Example(stringified(value.get("text")), list(value.get("extractions") or []))


def issues(examples: list[Example | dict]) -> list[str]:
    """What is wrong with the examples, in order."""
    found = []
    for i, example in enumerate(map(Example.of, examples)):
        if not strip(example.text):
            found.append(f"example {i} text is empty")
        if not example.extractions:
            found.append(f"example {i} has no extractions")
        for k, x in enumerate(example.extractions):
            text = stringified(x.get("text") or x.get("extraction_text"))
            if not strip(text):
                found.append(f"example {i} extraction {k} text is empty")
            elif text not in example.text:
                found.append(f"example {i} extraction {k} text is not present in example text")
    return found


def validate(examples: list[Example | dict], mode: str = "warning", out=None) -> None:
    """Once for a job: nothing, a line on ``out`` (standard error), or PromptValidationError."""
    if mode not in ("off", "warning", "error"):
        raise ValueError(f"invalid prompt validation mode: {mode}")
    if mode != "off" and (found := issues(examples)):
        message = f"Prompt examples failed validation: {'; '.join(found)}"
        if mode == "error":
            raise PromptValidationError(message)
        print(message, file=out or sys.stderr)


def issue_column(text: Column, extraction_text: Column) -> Column:
    """The issue of one (text, extraction text) row of an example table, or null."""
    blank = F.btrim(F.coalesce(extraction_text, F.lit("")), F.lit(" \t\n\x0b\x0c\r\0")) == ""
    return F.when(blank, F.lit("text is empty")).when(~F.contains(F.coalesce(text, F.lit("")), extraction_text), F.lit("text is not present in example text"))


def examples_section(examples: list[Example | dict]) -> str | None:
    parts = [f"Example {i + 1} text:\n{x.text}\nExample {i + 1} extractions:\n{json.dumps(x.extractions, indent=2, ensure_ascii=False)}" for i, x in enumerate(map(Example.of, examples))]
    return "\n\n".join(parts) or None


def pass_section(index: int, total: int) -> str:
    return f"Extraction pass: {index + 1} of {total}. Return grounded extractions for this pass."


def assembled(task: str, text: str, *, examples: str | None = None, additional_context: str | None = None, before: str = "", after: str = "", window: int = 0, pass_index: int = 0, total_passes: int = 1) -> str:
    """One prompt; the kernels' form of :func:`prompt_column`."""
    sections = [
        TASK + task,
        None if additional_context is None else CONTEXT + additional_context,
        pass_section(pass_index, total_passes) if total_passes > 1 else None,
        f"{BEFORE}{before}\n\n{AFTER}{after}" if window > 0 else None,
        examples,
        TEXT + text,
        CONTRACT,
    ]
    return "\n\n".join(s for s in sections if s is not None)


def window_columns(document: Column, start: Column, end: Column, chars: int) -> tuple[Column, Column]:
    """Up to ``chars`` code points before and after [start, end)."""
    first = F.greatest(start - chars, F.lit(0))
    return F.substring(document, first + 1, start - first), F.substring(document, end + 1, F.lit(chars))


def prompt_column(task: str, text: Column, pass_index: Column, *, examples: str | None = None, additional_context: str | None = None, before: Column | None = None, after: Column | None = None, total_passes: int = 1) -> Column:
    """A prompt of sections joined by blank lines; sections that don't apply are null, which concat_ws skips."""
    return F.concat_ws(
        "\n\n",
        F.lit(TASK + task),
        F.lit(None if additional_context is None else CONTEXT + additional_context).cast("string"),
        F.format_string(pass_section(0, 0).replace("1 of 0", "%d of %d"), (pass_index + 1).cast("int"), F.lit(total_passes)) if total_passes > 1 else F.lit(None).cast("string"),
        F.lit(None).cast("string") if before is None else F.concat(F.lit(BEFORE), before, F.lit("\n\n" + AFTER), after),
        F.lit(examples).cast("string"),
        F.concat(F.lit(TEXT), text),
        F.lit(CONTRACT),
    )


def prompts(chunks: DataFrame, docs: DataFrame | None, task: str, *, examples: list | None = None, additional_context: str | None = None, context_window_chars: int = 0, passes: int = 1, validation: str = "warning") -> DataFrame:
    """doc_seq, chunk_index, pass_index, prompt for each chunk and pass.

    Context windows are those of ``chunks`` (before, after), or are cut from ``docs`` (doc_seq, text), which is joined for
    them. Passes are a bounded explode, not a join.
    """
    validate(examples or [], validation)
    before = after = None
    if context_window_chars > 0 and "before" in chunks.columns:
        before, after = F.col("before"), F.col("after")
    elif context_window_chars > 0:
        chunks = chunks.join(docs.select("doc_seq", F.col("text").alias("document")), "doc_seq")
        before, after = window_columns(F.col("document"), F.col("start_pos"), F.col("end_pos"), context_window_chars)
    each = chunks.withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    text = prompt_column(task, F.col("text"), F.col("pass_index"), examples=examples_section(examples or []), additional_context=additional_context, before=before, after=after, total_passes=passes)
    return each.select("doc_seq", "chunk_index", "pass_index", text.alias("prompt"))
