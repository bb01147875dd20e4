"""Alignment of extracted texts to their documents: exact, then without regard to case, then fuzzy.

Items of one model answer are aligned in order; an interval that an earlier item took is
avoided where another can be had. The kernels are per document, so the DataFrame forms
need a shuffle only to bring documents and items together.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlignmentError
from ..functions.similarity import Scorer
from ..functions.textops import collapsed, fold, for_match, strip
from ..schemas import ANNOTATED, DOCUMENTS
from .tokens import UNICODE_TOKENS, Tokenizer, covering

THRESHOLD, MOST_STARTS = 0.78, 4000
SHORTEST, LONGEST = 0.65, 1.35

Span = tuple[int, int]
#: What collapsing drops or strips.
_SPACES = frozenset(" \t\n\x0b\x0c\r\0")


class Taken:
    """Disjoint intervals, for asking whether another overlaps any."""

    def __init__(self):
        self._starts: list[int] = []
        self._ends: list[int] = []

    def overlaps(self, span: Span) -> bool:
        i = bisect_right(self._ends, span[0])
        return i < len(self._starts) and self._starts[i] < span[1]

    def add(self, span: Span) -> None:
        i = bisect_left(self._starts, span[0])
        self._starts.insert(i, span[0])
        self._ends.insert(i, span[1])


class Aligner:
    """One document: its tokens are found once, whatever the number of items, chunks and passes."""

    def __init__(self, text: str, tokenizer: Tokenizer = UNICODE_TOKENS, threshold: float = THRESHOLD, allow_overlaps: bool = False, suppress_errors: bool = True):
        self.text, self.threshold, self.allow_overlaps, self.suppress_errors = text, threshold, allow_overlaps, suppress_errors
        self.tokens = tokenizer.spans(text)
        self.starts = [s for s, _ in self.tokens]
        self._folded: dict[Span, str] = {}
        self._plain: str | None | bool = False

    @property
    def plain(self) -> str | None:
        """The whole text in lower case, if windows of it are what matching compares but for white space (parts of composed text are composed)."""
        if self._plain is False:
            folded = fold(self.text)
            self._plain = folded if len(folded) == len(self.text) and unicodedata.is_normalized("NFC", self.text) and unicodedata.is_normalized("NFC", folded) else None
        return self._plain

    def align(self, items: list[dict], document_id: str | None = None, preferred: Span | None = None) -> list[dict]:
        """Extractions of the items of one answer, in their order."""
        taken = Taken()
        return [self._one(x, i, document_id, preferred, taken) for i, x in enumerate(items)]

    def _one(self, item: dict, index: int, document_id: str | None, preferred: Span | None, taken: Taken) -> dict:
        span, status = self.place(item["text"], preferred, taken)
        if span and status != "overlap" and not self.allow_overlaps:
            taken.add(span)
        tokens = covering(self.tokens, *span) if span else None
        return {
            "extraction_class": item.get("extraction_class"), "text": item["text"], "description": item.get("description"), "attributes_json": item.get("attributes_json") or "{}",
            "char_interval": _interval(span), "token_interval": _interval(tokens), "alignment_status": status, "extraction_index": index, "group_id": item.get("group_id"), "document_id": document_id,
        }

    def place(self, target: str, preferred: Span | None = None, taken: Taken | None = None) -> tuple[Span | None, str]:
        """The interval of ``target`` and its status."""
        taken = taken or Taken()
        if not strip(target):
            return None, "ungrounded"
        ranges = [*([preferred] if preferred else []), (0, len(self.text))]
        for status, spans in (("exact", self._exact(target, ranges)), ("fuzzy", self._fuzzy(target, ranges))):
            first = None
            for span in spans:
                if self.allow_overlaps or not taken.overlaps(span):
                    return span, status
                first = first or span
            if first:
                return first, "overlap"
        if not self.suppress_errors:
            raise AlignmentError(f"nothing in the text is near enough to {target!r}")
        return None, "ungrounded"

    def _exact(self, target: str, ranges: list[Span]) -> Iterator[Span]:
        """Occurrences in each range, overlapping ones too; where a range has none, the first without regard to case."""
        for lo, hi in ranges:
            at, found = self.text.find(target, lo, hi), False
            while at >= 0:
                found = True
                yield at, at + len(target)
                at = self.text.find(target, at + 1, hi)
            if not found:
                if (lo, hi) not in self._folded:
                    self._folded[lo, hi] = fold(self.text[lo:hi])
                at = self._folded[lo, hi].find(fold(target))
                if at >= 0:
                    yield lo + at, lo + at + len(target)

    def _fuzzy(self, target: str, ranges: list[Span]) -> Iterator[Span]:
        """Windows at token starts that reach the threshold, the best first."""
        goal = for_match(target)
        if not goal or self.threshold > 1:
            return
        scorer = Scorer(goal, self.threshold)
        shortest = max(1, math.floor(len(target) * SHORTEST))
        longest = max(shortest, math.ceil(len(target) * LONGEST))
        best: dict[Span, float] = {}
        for lo, hi in ranges:
            for start in self._window_starts(lo, hi):
                last = min(start + longest, hi)
                for end, window in self._windows(scorer, start, shortest, last):
                    if (start, end) not in best and (score := scorer.score(window)) is not None:
                        best[start, end] = score
        yield from (span for span, _ in sorted(best.items(), key=lambda x: (-x[1], x[0])))

    def _windows(self, scorer: Scorer, start: int, shortest: int, last: int) -> Iterator[tuple[int, str]]:
        """Normalised windows from ``start``, without those that share too few characters with the target."""
        text = self.plain
        if text is None:
            for end in range(start + shortest, last + 1):
                yield end, for_match(self.text[start:end])
            return
        rest = dict(scorer.counts)
        # white space is counted in favour of a window: it may be there or not once runs are collapsed
        shared, solid, total = rest.get(" ", 0), 0, len(scorer.target)
        for end in range(start + 1, last + 1):
            c = text[end - 1]
            if c not in _SPACES:
                solid += 1
                if rest.get(c, 0) > 0:
                    rest[c] -= 1
                    shared += 1
            if end - start >= shortest and 2.0 * shared >= scorer.threshold * (total + solid) - 1e-9:
                yield end, collapsed(text[start:end])

    def _window_starts(self, lo: int, hi: int) -> list[int]:
        found = self.starts[bisect_left(self.starts, lo) : bisect_left(self.starts, hi)][:MOST_STARTS]
        if found:
            return found
        return [i for i in range(lo, hi) if strip(self.text[i]) or self.text[i] == "\0"][:MOST_STARTS]


def _interval(span: Span | None) -> dict | None:
    return None if span is None else {"start_pos": span[0], "end_pos": span[1]}


def grounded(extraction: dict) -> bool:
    return extraction["char_interval"] is not None and extraction["alignment_status"] not in ("ungrounded", "error")


def annotate(docs: DataFrame, items: DataFrame, tokenizer: Tokenizer = UNICODE_TOKENS, threshold: float = THRESHOLD, suppress_errors: bool = True, allow_overlaps: bool = False) -> DataFrame:
    """Documents with the extractions of ``items`` (doc_seq, item_index, text and any of the other item fields), no model involved.

    Items are gathered by document and joined; documents without items stay. A document with its items is one row, so
    what bounds a task is the largest document's number of items, not the corpus.
    """
    fields = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("extraction_class", "text", "description", "attributes_json", "group_id")]
    gathered = items.groupBy("doc_seq").agg(F.array_sort(F.collect_list(F.struct("item_index", *fields))).alias("items"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text, given in zip(frame["id"], frame["text"], frame["items"], strict=True):
                rows = [dict(x) for x in given] if given is not None else []
                out.append(Aligner(text or "", tokenizer, threshold, allow_overlaps, suppress_errors).align(rows, i) if rows else [])
            yield frame.drop(columns="items").assign(extractions=out)

    rows = docs.select(*DOCUMENTS.names).join(gathered, "doc_seq", "left")
    return rows.mapInPandas(run, ANNOTATED)


def starts_of(text: str, target: str) -> list[int]:
    """Start positions of all case-sensitive occurrences, overlapping ones too."""
    out = []
    at = text.find(target) if target else -1
    while at >= 0:
        out.append(at)
        at = text.find(target, at + 1)
    return out


def occurrence_rows(rows: DataFrame) -> DataFrame:
    """doc_seq, target, start_pos of every occurrence in rows (doc_seq, text, target): one Arrow pass, linear in texts and matches; a null text or target, or an empty one, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, targets = (part.column(c).to_pylist() for c in ("text", "target"))
                found = [starts_of(x or "", t or "") for x, t in zip(texts, targets, strict=True)]
                row = pa.array([k for k, x in enumerate(found) for _ in x], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_seq").take(row), part.column("target").take(row), pa.array([p for x in found for p in x], pa.int32())], names=["doc_seq", "target", "start_pos"])

    return rows.select("doc_seq", "text", "target").mapInArrow(run, "doc_seq long, target string, start_pos int")


def first_without_case(text: Column, target: Column) -> Column:
    """Start of the first occurrence without regard to (ASCII) case, or -1."""
    return F.call_function("locate", F.lower(target), F.lower(text)) - 1
