"""Similarity of two normalised strings: twice the matched characters over both lengths."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(target: str, candidate: str) -> float:
    """Matches by recursive longest common substrings, earliest in ``target`` first; not symmetric."""
    if target == candidate:
        return 1.0
    if not target or not candidate:
        return 0.0
    return SequenceMatcher(None, target, candidate, autojunk=False).ratio()


def similarity_column(target: Column, candidate: Column) -> Column:
    """:func:`similarity` of two columns; null if one is."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scored(target, candidate)


class Scorer:
    """Scores of candidates against one target that reach a threshold; cheap upper bounds go first and lose nothing."""

    def __init__(self, target: str, threshold: float):
        self.target, self.threshold = target, threshold
        self.counts = Counter(target)
        self.known: dict[str, float | None] = {}

    def score(self, candidate: str) -> float | None:
        if candidate not in self.known:
            self.known[candidate] = self._score(candidate)
        return self.known[candidate]

    def _score(self, candidate: str) -> float | None:
        total = len(self.target) + len(candidate)
        if total and self.target != candidate:
            if 2.0 * min(len(self.target), len(candidate)) / total < self.threshold:
                return None
            shared = sum(min(n, self.counts[c]) for c, n in Counter(candidate).items() if c in self.counts)
            if 2.0 * shared / total < self.threshold:
                return None
        found = similarity(self.target, candidate)
        return found if found >= self.threshold else None
