"""Sentences and chunks of documents, with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textops import WS, strip
from ..schemas import CHUNKS
from .tokens import UNICODE_TOKENS, Tokenizer, covering, span_rows

#: A sentence ends after marks, closers and white space (or at the end), or after two line ends.
BOUNDARY = rf"[.!?]+[)\"'\]]*(?:[{WS}]+|\z)|\n{{2,}}"
_BOUNDARY = re.compile(BOUNDARY.replace(r"\z", r"\Z"))
_SPACE = re.compile(rf"[{WS}]")


def sentence_tiles(text: Column) -> Column:
    """All sentences, blank ones included: concatenated, they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{BOUNDARY})|.+\z"), F.lit(0))


def sentences(docs: DataFrame, key: str = "doc_seq") -> DataFrame:
    """key, index, start_pos, end_pos of the sentences that aren't blank; built-in functions only."""
    t = docs.select(F.col(key), F.posexplode(sentence_tiles(F.col("text"))).alias("i", "s"))
    by_doc = Window.partitionBy(key).orderBy("i")
    t = t.withColumn("end_pos", F.sum(F.char_length("s")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.where(F.btrim("s", F.lit(" \t\n\x0b\x0c\r\0")) != "")
    return t.select(key, (F.row_number().over(by_doc) - 1).cast("int").alias("index"), (F.col("end_pos") - F.char_length("s")).cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))


def sentence_rows(docs: DataFrame, key: str = "doc_seq") -> DataFrame:
    """The rows of :func:`sentences` in one Arrow pass, without its shuffle."""
    return span_rows(docs, sentence_spans, key, with_text=False)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    ends = [m.end() for m in _BOUNDARY.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [(s, e) for s, e in zip([0, *ends], ends, strict=False) if strip(text[s:e])]


def _pieces(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A sentence cut to pieces: after the last white space that still fits, else where it's full. The last one may be empty."""
    while end - start > most:
        spaces = [m.start() for m in _SPACE.finditer(text, start + 1, start + most + 1)]
        cut = spaces[-1] + 1 if spaces else start + most
        yield start, cut
        start = cut
    yield start, end


def chunk_spans(text: str, most: int = 2000) -> list[tuple[int, int]]:
    """Sentences packed greedily into chunks of at most ``most`` code points (one more if white space follows)."""
    if most <= 0:
        raise ValueError("max_char_buffer must be positive")
    out: list[tuple[int, int]] = []
    open_at: int | None = None
    end = 0
    for start, stop in sentence_spans(text):
        if open_at is not None and stop - open_at > most:
            out.append((open_at, end))
            open_at = None
        if open_at is None:
            *full, (open_at, _) = _pieces(text, start, stop, most)
            out += full
        end = stop
    if open_at is not None:
        out.append((open_at, end))
    return out


def chunks_of(text: str, most: int = 2000, tokenizer: Tokenizer = UNICODE_TOKENS) -> list[dict]:
    tokens = tokenizer.spans(text)
    out = []
    for i, (s, e) in enumerate(chunk_spans(text, most)):
        span = covering(tokens, s, e) or (None, None)
        out.append({"chunk_index": i, "text": text[s:e], "start_pos": s, "end_pos": e, "tok_start": span[0], "tok_end": span[1]})
    return out


def chunked(docs: DataFrame, max_char_buffer: int = 2000, tokenizer: Tokenizer = UNICODE_TOKENS, context_window_chars: int = 0) -> DataFrame:
    """Chunks of (doc_seq, id, text): one Arrow pass, no shuffle. With a context window, ``before`` and ``after`` come along, so prompts need no join."""
    if max_char_buffer <= 0:
        raise ValueError("max_char_buffer must be positive")
    n = context_window_chars
    schema = T.StructType([*CHUNKS.fields, *[T.StructField(c, T.StringType()) for c in ("before", "after") if n > 0]])

    def beside(chunk: dict, text: str) -> dict:
        return chunk | {"before": text[max(0, chunk["start_pos"] - n) : chunk["start_pos"]], "after": text[chunk["end_pos"] : chunk["end_pos"] + n]} if n > 0 else chunk

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [beside(c, text) | {"doc_seq": seq, "document_id": i} for seq, i, text in zip(frame["doc_seq"], frame["id"], frame["text"], strict=True) if text for c in chunks_of(text, max_char_buffer, tokenizer)]
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({c: "Int32" for c in ("chunk_index", "start_pos", "end_pos", "tok_start", "tok_end")})

    return docs.select("doc_seq", "id", "text").mapInPandas(run, schema)
