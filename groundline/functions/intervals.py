"""Half-open intervals [start_pos, end_pos): values, and predicates on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True, order=True)
class Interval:
    start_pos: int
    end_pos: int

    def __post_init__(self):
        if self.start_pos < 0 or self.end_pos < self.start_pos:
            raise ValueError(f"not an interval: {self}")

    def __len__(self) -> int:
        return self.end_pos - self.start_pos

    def overlaps(self, other: Interval) -> bool:
        return self.start_pos < other.end_pos and other.start_pos < self.end_pos

    def contains(self, other: Interval) -> bool:
        return self.start_pos <= other.start_pos and other.end_pos <= self.end_pos

    def shift(self, by: int) -> Interval:
        return Interval(self.start_pos + by, self.end_pos + by)

    def __str__(self) -> str:
        return f"[{self.start_pos}, {self.end_pos})"


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)
