"""Words, sentences and passages of many texts at once, with hashes that don't depend on where they stand.

A passage is a stretch of ``PASSAGE`` words, so every text of that many has one at each
of its words. Passages are told apart cheaply by their anchor: the least hash among the
runs of ``RUN`` words in them. Equal passages have equal anchors, and neighbours mostly
share one, so anchors are few (about 2 in 37 words).
"""

from __future__ import annotations

import numpy as np

from .rolling import Rolling, mixed, slid

RUN, PASSAGE = 16, 51
_rng = np.random.default_rng(77001)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A number for each byte, A-Z as a-z.
_BYTE = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_LOWER]
#: Keys of sentences are apart from those of passages.
_SENTENCE = np.uint64(0x9E3779B97F4A7C15)
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, *range(9, 14)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


class Words:
    """Words of all texts end to end: ``first`` and ``last`` are their bytes in ``data``, ``doc`` their texts.

    A sentence ends with a word before a line end, or one that ends in a full stop, question or exclamation mark.
    """

    def __init__(self, texts: list):
        self.data = data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        size = np.array([len(x) + 1 for x in texts], np.int64)
        self.ends = np.cumsum(size) - 1
        self.begins = self.ends - size + 1
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_IS_WS[data]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.first, self.last = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.first, "right")
        #: The first word of each text, and one past the last of all.
        self.opens = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        h = Rolling(_BYTE[data], 0).of(self.first, self.last)
        self._one, self._two = Rolling(h, 1), Rolling(h, 2)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        breaks = np.ones(len(self.first), bool)
        breaks[:-1] = (lines[self.first[1:]] != lines[self.last[:-1]]) | _STOPS[data[self.last[:-1] - 1]]
        #: Words of each sentence: [start, end).
        self.sentence_end = np.flatnonzero(breaks) + 1
        self.sentence_start = np.concatenate([[0], self.sentence_end[:-1]])[: len(self.sentence_end)]

    def sentences(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, and 64 and 32 bits of a digest, of each sentence of ``which``."""
        return self._hashed(self.sentence_start[which], self.sentence_end[which], _SENTENCE)

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of all passages, and their keys: the anchors."""
        n = len(self.first)
        if n < PASSAGE:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - RUN + 1)
        least = slid(self._one.of(at, at + RUN), PASSAGE - RUN + 1, np.minimum)
        inside = np.flatnonzero(self.doc[: n - PASSAGE + 1] == self.doc[PASSAGE - 1 :])
        return inside, least[inside]

    def passage_digests(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._hashed(start, start + PASSAGE, np.uint64(0))[1:]

    def _hashed(self, start: np.ndarray, end: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = self._one.of(start, end) ^ salt, self._two.of(start, end) ^ salt
        return one, two, (mixed(one ^ np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
