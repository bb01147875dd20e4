"""A logarithmic family of suffix arrays over the first ``width`` bytes of suffixes.

``LogIndex.add`` takes suffixes with an owner each, in batches: a batch is sorted (its
suffix array), merge-scanned against every existing level for equal ``width``-byte
prefixes, and the smallest owner so far of each suffix is returned. The batch then
becomes a level, and a level merges with the one before while that has at most twice its
suffixes, so sizes fall geometrically: n suffixes live in O(log n) sorted arrays, each of
them merged O(log n) times. Equal prefixes are kept once, with their smallest owner.
Bytes are compared, never hashes. Neighbouring suffixes that match make one long match
(the caller's windows are next to each other in the text).

Owners may come in any order, but an answer only knows the batches so far; a caller that
adds suffixes by ascending owner gets the smallest of all. More batches can follow at any
time; ``levels`` holds all there is to keep between them.
"""

from __future__ import annotations

import numpy as np


def suffix_order(rows: np.ndarray) -> np.ndarray:
    """Lexicographic order of the rows of a 2-D uint8 array."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    words = wide.view(">u8").astype("<u8")
    return np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows as values that compare as their bytes do (``V`` doesn't sort, ``S`` would drop zeros at the end)."""
    n, width = rows.shape
    closed = np.ones((n, width + 1), np.uint8)
    closed[:, :width] = rows
    return closed.view(f"S{width + 1}").ravel()


def merge_scan(there: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending arrays without repeats: the order that merges them end to end (a stable merge sort of two runs is one linear merge), and for each of ``new`` the place of its equal in ``there``, or -1."""
    both = np.concatenate([there, new])
    order = np.argsort(both, kind="stable")
    twin = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    place = np.full(len(new), -1)
    place[order[twin + 1] - len(there)] = order[twin]
    return order, place


class LogIndex:
    def __init__(self, width: int, batch: int = 1 << 18):
        self.width, self.batch = width, batch
        #: (sorted keys, smallest owner of each), larger ones first
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """rows: uint8 (n, width), a view will do: ``batch`` of them are copied at a time. Smallest owner per row."""
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), self.batch):
            out[at : at + self.batch] = self._add(rows[at : at + self.batch], owners[at : at + self.batch])
        return out

    def _add(self, rows: np.ndarray, owners: np.ndarray) -> np.ndarray:
        order = suffix_order(rows)
        keys = as_keys(rows)[order]
        lead = np.ones(len(keys), bool)
        lead[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(lead)
        level, least = keys[at], np.minimum.reduceat(owners[order], at)
        fresh = np.ones(len(level), bool)
        for k, (there, owned) in enumerate(self.levels):
            _, place = merge_scan(there, level)
            hit = place >= 0
            least[hit] = np.minimum(least[hit], owned[place[hit]])
            self.levels[k][1][place[hit]] = least[hit]
            fresh &= ~hit
        out = np.empty(len(rows), np.int64)
        out[order] = least[np.cumsum(lead) - 1]
        self._push(level[fresh], least[fresh])
        return out

    def _push(self, keys: np.ndarray, owners: np.ndarray) -> None:
        if not len(keys):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(keys):
            there, owned = self.levels.pop()
            order, _ = merge_scan(there, keys)
            keys, owners = np.concatenate([there, keys])[order], np.concatenate([owned, owners])[order]
        self.levels.append((keys, owners))
