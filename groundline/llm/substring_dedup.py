"""Substring dedup by hashing of units (operator 10).

Units of a text are its sentences (lines and so paragraphs are cut at sentence ends) and,
since a passage may begin or end within a sentence, its passages: every stretch of
``passages.PASSAGE`` = 51 words. A unit is normalised (A-Z lowered, white space between
words is all the same) and hashed; digests are grouped over all documents. What goes:

- a sentence of ``min_words`` words or more that an earlier document has, or that stands
  earlier in the same document, with the white space after it;
- every word of a passage that an earlier document has, wherever it stands there. So a
  shared stretch of 51 words or more goes whole, to the word, and a shorter one only as
  far as it is whole sentences.

Documents rank by doc_id; units are judged on the input, not on what is left. Offsets of
what goes are those of the original text. Sentences of fewer words stay, they recur by
chance (``min_words``: 6).

How: texts are dealt to chunks once (``exchange``). A chunk sends short keys of its
sentences and of the anchors of its passages and learns which of them recur; of units
under those keys it sends each distinct digest (96 bits) once, with the smallest and the
largest doc_id that the chunk has for it, and gets back the smallest of all. Digests are
dealt by themselves, not by their keys, so an anchor that a third of all documents have
amid different words is spread like any other content; a digest that all have costs its
bucket one entry for each chunk. Of m different units that meet, two have one digest with
a probability of about m²/2^97 (m = 10^9: 10^-11), taking the hashes as random.

Edge cases: null or empty text has no units; a null doc_id ranks last; rows that share a
doc_id (null ones too) never remove each other's units, each gives a row; a text that
repeats its own words loses the later of its equal sentences, and no passages by itself;
texts of any length are read in linear passes, whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts
from .exchange import BLOBS, bucket_of, buffers, common, dealt, distinct_keys, owners, packed, recurring, rows_of, send_keys, split, unpacked
from .passages import PASSAGE, Words

MIN_WORDS = 6
#: Bytes of text of a chunk. Kernels need about 100 times as much memory.
CHUNK_BYTES = 2 << 20
#: ``note`` goes back to the chunk as it came.
UNITS = f"{BLOBS}, note binary"
RESULT = "doc_id long, n_units long, n_removed long, n_removed_chars long, spans string, kept_sha256 string"
KEPT = "doc_id long, spans array<struct<start:int,end:int>>, text string"


class Chunk:
    """Documents of a chunk with their units: the sentences that take part, then the passages."""

    def __init__(self, table: pa.Table, min_words: int):
        self.ids, self.null = owners(table)
        self.words = w = Words(buffers(table))
        self.sentence = np.flatnonzero(w.sentence_end - w.sentence_start >= min_words)
        self.passage, anchor = w.passages()
        own, *self._digest = w.sentences(self.sentence)
        self.doc = np.concatenate([w.doc[w.sentence_start[self.sentence]], w.doc[self.passage]])
        self.key = np.concatenate([own, anchor])
        self.owner = self.ids[self.doc]

    def digests(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for each of ``units`` (ascending)."""
        n = len(self.sentence)
        few = np.searchsorted(units, n)
        more = self.words.passage_digests(self.passage[units[few:] - n])
        return tuple(np.concatenate([x[units[:few]], y]) for x, y in zip(self._digest, more, strict=True))


class Groups(NamedTuple):
    """Distinct digests of a chunk's units under recurring keys."""

    order: np.ndarray  # the units, equal ones together
    lead: np.ndarray  # where each group starts in ``order``
    high: np.ndarray
    low: np.ndarray
    least: np.ndarray  # smallest and largest doc_id
    most: np.ndarray


def _groups(c: Chunk, often: np.ndarray, key: np.ndarray) -> Groups:
    units = np.flatnonzero(often[np.searchsorted(key, c.key)]) if len(key) else np.zeros(0, np.int64)
    high, low = c.digests(units)
    order = np.lexsort((low, high))
    units, high, low = units[order], high[order], low[order]
    if not len(units):
        return Groups(units, units, high, low, units, units)
    at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    owner = c.owner[units]
    return Groups(units, at, high[at], low[at], np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at))


def _send_units(min_words: int, buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            chunk, c = left.column("chunk")[0].as_py(), Chunk(left, min_words)
            key, _ = distinct_keys(c.key, c.owner)
            often, _ = recurring(key, buckets, right)
            if often.any():
                g = _groups(c, often, key)
                rows = [(b, packed(g.high[x], g.low[x], g.least[x], g.most[x] - g.least[x]), None) for b, x in split(bucket_of(g.high, buckets))]
                rows.append((chunk % buckets, None, np.packbits(often).tobytes()))
                return rows_of(UNITS, bucket=[r[0] for r in rows], chunk=[chunk] * len(rows), blob=[r[1] for r in rows], note=[r[2] for r in rows])
        return rows_of(UNITS, bucket=[], chunk=[], blob=[], note=[])

    return send


def _earliest(table: pa.Table) -> pa.Table:
    """For each chunk, in its order: one bit for each digest, whether a smaller doc_id than the chunk's largest has it, and that doc_id if so."""
    bucket = table.column("bucket")[0].as_py()
    chunks, blobs, notes = (table.column(c).to_pylist() for c in ("chunk", "blob", "note"))
    rows = [(k, None, n) for k, n in zip(chunks, notes, strict=True) if n is not None]
    sent = [(k, unpacked(b, "u8", "u4", "i8", "i8")) for k, b in zip(chunks, blobs, strict=True) if b is not None]
    if sent:
        high, low, least, more = (np.concatenate([x[k] for _, x in sent]) for k in range(4))
        order = np.lexsort((low, high))
        lead = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
        who = np.empty(len(high), np.int64)
        who[order] = np.minimum.reduceat(least[order], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        useful = who < least + more
        edge = np.cumsum([0] + [len(x[0]) for _, x in sent])
        for (k, _), s, e in zip(sent, edge[:-1], edge[1:], strict=True):
            if useful[s:e].any():
                rows.append((k, packed(np.packbits(useful[s:e]), who[s:e][useful[s:e]]), None))
    return rows_of(UNITS, bucket=[bucket] * len(rows), chunk=[r[0] for r in rows], blob=[r[1] for r in rows], note=[r[2] for r in rows])


def _gone(c: Chunk, right: pa.Table, buckets: int) -> np.ndarray:
    """Which units go."""
    gone = np.zeros(len(c.key), bool)
    blobs, note = {}, None
    for b, blob, n in zip(*(right.column(x).to_pylist() for x in ("bucket", "blob", "note")), strict=True):
        if n is not None:
            note = n
        else:
            blobs[b] = blob
    if note is not None:
        key, _ = distinct_keys(c.key, c.owner)
        g = _groups(c, np.unpackbits(np.frombuffer(note, np.uint8))[: len(key)].astype(bool), key)
        who = np.full(len(g.high), np.iinfo(np.int64).max)
        for b, x in split(bucket_of(g.high, buckets)):
            if b in blobs:
                useful, least = unpacked(blobs[b], "u1", "i8")
                who[x[np.unpackbits(useful)[: len(x)].astype(bool)]] = least
        group = np.zeros(len(g.order), np.int64)
        group[g.lead[1:]] = 1
        gone[g.order] = who[np.cumsum(group)] < c.owner[g.order]
    n = len(c.sentence)
    if n:  # repeats within a document
        high, low = c.digests(np.arange(n))
        order = np.lexsort((np.arange(n), low, high, c.doc[:n]))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1]) & (c.doc[order][1:] == c.doc[order][:-1])
        gone[order[1:][same]] = True
    return gone


class Removed(NamedTuple):
    """Removed spans of all texts of a chunk: bytes in ``Words.data``, and the text of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def _spans(c: Chunk, gone: np.ndarray) -> Removed:
    """Maximal spans: whole words, and the white space between and after removed sentences."""
    w, n = c.words, len(c.sentence)
    words = len(w.first)
    cover, after = np.zeros(words + 1, np.int32), np.zeros(words, bool)
    s = c.sentence[gone[:n]]
    start, end = np.concatenate([w.sentence_start[s], c.passage[gone[n:]]]), np.concatenate([w.sentence_end[s], c.passage[gone[n:]] + PASSAGE])
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    lost = np.cumsum(cover[:words]) > 0
    after[w.sentence_end[s] - 1] = True
    opens, closes = np.ones(words, bool), np.ones(words, bool)
    opens[1:] = ~lost[:-1] | (w.doc[1:] != w.doc[:-1])
    closes[:-1] = ~lost[1:] | (w.doc[1:] != w.doc[:-1])
    head, tail = np.flatnonzero(lost & opens), np.flatnonzero(lost & closes)
    final = np.append(w.doc[1:] != w.doc[:-1], True)[:words]
    until = np.where(final[tail], w.ends[w.doc[tail]], w.first[np.minimum(tail + 1, words - 1)]) if len(tail) else tail
    return Removed(w.first[head], np.where(after[tail], until, w.last[tail]), w.doc[head])


def _results(c: Chunk, r: Removed) -> list[tuple[list[tuple[int, int]], bytes]]:
    """Removed spans in code points, and the bytes that stay, for each text."""
    w = c.words
    point = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    lo, hi = np.searchsorted(r.doc, np.arange(len(c.ids)), "left"), np.searchsorted(r.doc, np.arange(len(c.ids)), "right")
    out = []
    for k, (b, e) in enumerate(zip(w.begins.tolist(), w.ends.tolist(), strict=True)):
        s, t = r.start[lo[k] : hi[k]], r.end[lo[k] : hi[k]]
        raw = w.data[b:e].tobytes()
        edges = [0, *np.stack([s - b, t - b], 1).ravel().tolist(), e - b]
        out.append((list(zip((point[s] - point[b]).tolist(), (point[t] - point[b]).tolist(), strict=True)), b"".join(raw[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True)) if len(s) else raw))
    return out


def _kept(c: Chunk, gone: np.ndarray, results: list) -> pa.Table:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    spans = pa.array([[{"start": s, "end": e} for s, e in x] for x, _ in results], kind)
    return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "spans": spans, "text": pa.array([x.decode("utf-8", "replace") for _, x in results], pa.string())})


def _digests(c: Chunk, gone: np.ndarray, results: list) -> pa.Table:
    n = len(c.ids)
    return pa.table(
        {
            "doc_id": pa.array(c.ids, mask=c.null),
            "n_units": pa.array(np.bincount(c.words.doc[c.words.sentence_start], minlength=n).astype(np.int64)),
            "n_removed": pa.array(np.bincount(c.doc[gone], minlength=n).astype(np.int64)),
            "n_removed_chars": pa.array([sum(e - s for s, e in x) for x, _ in results], pa.int64()),
            "spans": pa.array([",".join(f"{s}:{e}" for s, e in x) for x, _ in results], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, x in results], pa.string()),
        }
    )


def _finish(min_words: int, buckets: int, make):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, min_words)
        gone = _gone(c, right, buckets)
        return make(c, gone, _results(c, _spans(c, gone)))

    return finish


def _applied(docs: DataFrame, min_words: int, make, schema: str) -> DataFrame:
    buckets, base = parts(docs.sparkSession), dealt(docs, CHUNK_BYTES)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        c = Chunk(table, min_words)
        return c.key, c.owner

    chunks = base.groupBy("chunk")
    often = chunks.applyInArrow(send_keys(keys_of, buckets), BLOBS).groupBy("bucket").applyInArrow(common, BLOBS)
    units = chunks.cogroup(often.groupBy("chunk")).applyInArrow(_send_units(min_words, buckets), UNITS)
    found = units.groupBy("bucket").applyInArrow(_earliest, UNITS)
    return chunks.cogroup(found.groupBy("chunk")).applyInArrow(_finish(min_words, buckets, make), schema)


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the removed spans (start, end in code points of the original text) and the text that stays."""
    return _applied(docs, min_words, _kept, KEPT)


def dedup_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, numbers of sentences and of units that go (sentences and passages), removed code points, spans and the digest of what stays."""
    return _applied(docs, min_words, _digests, RESULT)
