"""Tokens with code-point offsets, in two forms with the same rows.

``token_rows`` finds them where the documents are: an Arrow pass and no shuffle, which is
what to use at scale. ``with_offsets`` needs built-in functions only, at the price of a
shuffle of all tokens, since offsets are running sums over a document's tokens.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textops import WS

#: Patterns in Java's syntax. Words: a letter and what may follow it; numbers with inner . and ,; any other character.
NON_SPACE = rf"[^{WS}]+"
UNICODE = rf"\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_'-]*|\p{{N}}+(?:[.,]\p{{N}}+)*|[^{WS}]"


@dataclass(frozen=True)
class Tokenizer:
    """A token pattern. Patterns beyond Python's ``re`` (\\p{L}) are compiled by ``regex``."""

    pattern: str = UNICODE
    _compiled: list = field(default_factory=list, repr=False, compare=False)

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self._compiled:
            import regex

            self._compiled.append(regex.compile(self.pattern))
        return [m.span() for m in self._compiled[0].finditer(text)]

    def __getstate__(self):
        return {"pattern": self.pattern, "_compiled": []}

    def __setstate__(self, state):
        self.__dict__.update(state)


UNICODE_TOKENS, NON_SPACE_TOKENS = Tokenizer(UNICODE), Tokenizer(NON_SPACE)


def tokenize(text: str, tokenizer: Tokenizer = UNICODE_TOKENS) -> list[dict]:
    return [{"index": i, "text": text[s:e], "start_pos": s, "end_pos": e} for i, (s, e) in enumerate(tokenizer.spans(text))]


def covering(spans: list[tuple[int, int]], start: int, end: int) -> tuple[int, int] | None:
    """[first, last + 1) of the tokens that overlap [start, end); tokens are disjoint and in order."""
    first = bisect_right(spans, start, key=lambda x: x[1])
    last = bisect_left(spans, end, key=lambda x: x[0])
    if start >= end:  # an empty interval overlaps the token it lies strictly within
        return (first, first + 1) if first < len(spans) and spans[first][0] < start < spans[first][1] else None
    return (first, last) if first < last else None


def tiles(text: Column, pattern: str) -> Column:
    """Tokens with the white space before each: what lies between matches must be white space."""
    pieces = F.lit(rf"([{WS}]*)({pattern})")
    return F.arrays_zip(F.regexp_extract_all(text, pieces, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pieces, F.lit(2)).alias("token"))


def with_offsets(docs: DataFrame, pattern: str = UNICODE, key: str = "doc_seq") -> DataFrame:
    """key, index, text, start_pos, end_pos of every token; built-in functions only.

    Offsets are running sums of lengths, by a window over a document's tokens: one shuffle by document, and a window
    that holds one document at a time.
    """
    t = docs.select(F.col(key), F.posexplode(tiles(F.col("text"), pattern)).alias("index", "t"))
    gap, token = F.char_length("t.gap"), F.char_length("t.token")
    upto = F.sum(gap + token).over(Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    return t.select(key, F.col("index").cast("int").alias("index"), F.col("t.token").alias("text"), (upto - token).cast("int").alias("start_pos"), upto.cast("int").alias("end_pos"))


def span_rows(docs: DataFrame, find, key: str = "doc_seq", with_text: bool = True) -> DataFrame:
    """key, index, [text,] start_pos, end_pos of the spans that ``find`` gives for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                found = [find(t) if t else [] for t in texts]
                n = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
                first = np.repeat(np.cumsum(n) - n, n)
                cols = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), n))), pa.array((np.arange(len(flat)) - first).astype(np.int32))]
                if with_text:
                    cols.append(pa.array([t[s:e] for t, f in zip(texts, found, strict=True) for s, e in f], pa.string()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=names)

    names = [key, "index", *["text"] * with_text, "start_pos", "end_pos"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, index int, {'text string, ' if with_text else ''}start_pos int, end_pos int")


def token_rows(docs: DataFrame, tokenizer: Tokenizer = UNICODE_TOKENS, key: str = "doc_seq") -> DataFrame:
    """key, index, text, start_pos, end_pos of every token; no shuffle, any pattern."""
    return span_rows(docs, tokenizer.spans, key)


def counted(text: Column, pattern: str = UNICODE) -> Column:
    """Number of tokens of a text, without exploding it."""
    return F.regexp_count(text, F.lit(pattern))
