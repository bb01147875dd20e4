"""Extraction over DataFrames: chunks, prompts, model, parsing, alignment and merging.

Two plans with the same results. :func:`extract` fuses all steps for a document in one
Arrow pass: no shuffle. :func:`model_outputs` and :func:`extract_from_outputs` part at the
model: answers are written once, so a lost executor or a rerun never asks the model twice,
and chunks of one long document can go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatParsingError
from ..operators import chunks, models, parsing, prompts
from ..operators.alignment import THRESHOLD, Aligner
from ..operators.merging import merge
from ..operators.tokens import UNICODE_TOKENS, Tokenizer
from ..schemas import ANNOTATED, DOCUMENTS, MODEL_OUTPUTS
from ..sources import documents


@dataclass(frozen=True)
class Options:
    prompt_description: str
    examples: list = field(default_factory=list)
    additional_context: str | None = None
    max_char_buffer: int = 2000
    context_window_chars: int = 0
    extraction_passes: int = 1
    format: str = "auto"
    strict: bool = True
    prompt_validation: str = "warning"
    suppress_parse_errors: bool = False
    suppress_alignment_errors: bool = True
    allow_overlaps: bool = False
    fuzzy_threshold: float = THRESHOLD
    tokenizer: Tokenizer = UNICODE_TOKENS

    def __post_init__(self):
        if self.max_char_buffer <= 0:
            raise ValueError("max_char_buffer must be positive")

    def aligner(self, text: str) -> Aligner:
        return Aligner(text, self.tokenizer, self.fuzzy_threshold, self.allow_overlaps, self.suppress_alignment_errors)

    def items(self, output: str) -> list[dict]:
        try:
            return [parsing.row_of(x) for x in parsing.parse(output, self.format, self.strict)]
        except FormatParsingError:
            if not self.suppress_parse_errors:
                raise
            return []


def extract_document(model: Any, text: str, doc_id: str | None, options: Options, examples: str | None = None) -> list[dict]:
    """The merged extractions of one document."""
    aligner, found, n = options.aligner(text), [], options.context_window_chars
    for s, e in chunks.chunk_spans(text, options.max_char_buffer):
        for k in range(options.extraction_passes):
            prompt = prompts.assembled(
                options.prompt_description, text[s:e], examples=examples, additional_context=options.additional_context,
                before=text[max(0, s - n) : s], after=text[e : e + n], window=n, pass_index=k, total_passes=options.extraction_passes,
            )
            found += aligner.align(options.items(models.call(model, prompt)), doc_id, (s, e))
    return merge(found, options.allow_overlaps)


def _prepared(model: Any, prompt_description: str, kept: dict) -> tuple[Options, str | None]:
    models.checked(model)
    options = Options(prompt_description, **kept)
    prompts.validate(options.examples, options.prompt_validation)
    return options, prompts.examples_section(options.examples)


def extract(docs: DataFrame, model: Any, prompt_description: str, **kept) -> DataFrame:
    """Annotated documents of (doc_seq, id, text, metadata_json); the keyword options are those of :class:`Options`.

    The model is pickled to the executors. It is asked again if a task is: use the other plan where that matters.
    """
    options, examples = _prepared(model, prompt_description, kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(extractions=[extract_document(model, t or "", i, options, examples) for t, i in zip(frame["text"], frame["id"], strict=True)])

    return docs.select(*DOCUMENTS.names).mapInPandas(run, ANNOTATED)


def model_outputs(docs: DataFrame, model: Any, prompt_description: str, path: str | None = None, **kept) -> DataFrame:
    """doc_seq, chunk_index, pass_index, output_text of every prompt; written to ``path`` and read again if given."""
    options, _ = _prepared(model, prompt_description, kept)
    parts = chunks.chunked(docs, options.max_char_buffer, options.tokenizer, options.context_window_chars)
    asked = prompts.prompts(
        parts, None, options.prompt_description, examples=options.examples, additional_context=options.additional_context,
        context_window_chars=options.context_window_chars, passes=options.extraction_passes, validation="off",
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="prompt").assign(output_text=[models.call(model, p) for p in frame["prompt"]])

    out = asked.mapInPandas(run, MODEL_OUTPUTS)
    if path:
        out.write.mode("overwrite").parquet(path)
        out = docs.sparkSession.read.schema(MODEL_OUTPUTS).parquet(path)
    return out


def extract_from_outputs(docs: DataFrame, outputs: DataFrame, prompt_description: str = "", **kept) -> DataFrame:
    """Annotated documents from recorded answers, for the same options; one shuffle by document."""
    options = Options(prompt_description, **kept)
    gathered = outputs.groupBy("doc_seq").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "pass_index", "output_text"))).alias("outputs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, i, answers in zip(frame["text"], frame["id"], frame["outputs"], strict=True):
                spans = chunks.chunk_spans(text or "", options.max_char_buffer) if answers is not None else []
                aligner = options.aligner(text or "")
                out.append(merge([x for a in (answers if answers is not None else []) for x in aligner.align(options.items(a["output_text"]), i, spans[a["chunk_index"]])], options.allow_overlaps))
            yield frame.drop(columns="outputs").assign(extractions=out)

    return docs.select(*DOCUMENTS.names).join(gathered, "doc_seq", "left").mapInPandas(run, ANNOTATED)


def extract_text(spark: SparkSession, text: str, model: Any, prompt_description: str, **kept):
    """One text; its annotated document as a row."""
    return extract(documents.from_text(spark, text), model, prompt_description, **kept).first()


def extraction_rows(annotated: DataFrame) -> DataFrame:
    """One row for each extraction: doc_seq, seq and its fields."""
    return annotated.select("doc_seq", F.posexplode("extractions").alias("seq", "x")).select("doc_seq", "seq", "x.*")
