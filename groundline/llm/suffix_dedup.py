"""Substring dedup on bytes by suffix arrays (operator 1).

A byte goes if a ``WIDTH``-byte string over it also starts in a document with a smaller
doc_id. Equal windows of WIDTH bytes have an equal anchor (the smallest hash among their
``GRAM``-byte grams), so only windows whose anchor occurs in two documents can match:

1. every chunk of documents sends the distinct anchors it has (a few bytes each, to the
   anchor's bucket) and learns which of them other documents have too (``exchange``);
2. it sends the text of the maximal runs of windows under these anchors, each distinct
   run once with its smallest and largest doc_id, so a run that a third of all documents
   have costs a bucket one record per chunk; equal texts share a chunk, so copies of whole
   texts send theirs once;
3. the bucket feeds the windows of all distinct runs, by ascending doc_id and a bounded
   batch at a time, to a logarithmic family of suffix arrays (``suffix_index.LogIndex``),
   which compares whole windows, and answers with the smallest doc_id for each stretch of
   windows;
4. the chunk marks the covered bytes.

An anchor that very many chunks have (a common phrase amid different words) is divided by
what is around it: windows that have it at one of eight neighbouring places share 43 bytes,
so their runs go to the bucket of these bytes, instead of all to the anchor's.

Runs are equal if their lengths and 128 bits of hashes are; of m different runs, two are
taken for one with a probability of about m²/2^129 (m = 10^12: 10^-15). All else is
compared by bytes. Texts never leave their chunk: one shuffle of texts serves all visits.

``earlier`` documents rank before all others, whatever their doc_ids: a new batch is
deduplicated against what has been accepted before, and only its rows are returned.

Edge cases: null or empty texts have no windows (kept as empty); a null doc_id ranks
after all others; rows that share a doc_id never remove each other's bytes and each
gives a row; texts shorter than WIDTH keep every byte; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .exchange import BLOBS, bucket_of, buffers, common, dealt_by_text, distinct_keys, of_planes, owners, packed, planes, recurring, rows_of, send_keys, split, unpacked
from .rolling import Rolling, mixed, slid
from .suffix_index import LogIndex

WIDTH, GRAM = 50, 20
#: Bytes of text of a chunk; kernels need about 100 times as much memory. There are as many chunks as it takes.
CHUNK_BYTES = 2 << 20
#: Buckets of anchors for each of the session's shuffle partitions.
BUCKETS = 2
#: Places of an anchor in a window that go together when it is divided.
PLACES = 8
#: Windows that are indexed at once.
BATCH = 1 << 18
_rng = np.random.default_rng(20240607)
_A, _B, _C = (np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 3))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rank of documents that were accepted before.
BEFORE = -(1 << 63)

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, text_bytes binary, starts array<long>, ends array<long>"
#: ``note`` goes back to the chunk as it came.
RUNS = f"{BLOBS}, note binary"


class Chunk:
    """Documents' bytes end to end, with their runs: maximal stretches of windows of one document under one anchor."""

    def __init__(self, table: pa.Table):
        self.ids, self.null = owners(table)
        if "accepted" in table.column_names:
            self.accepted = np.asarray(table.column("accepted"))
            self.ids[self.accepted] = BEFORE
        texts = buffers(table)
        size = np.array([x.size for x in texts], np.int64)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self._runs()
        self.owner = self.ids[self.doc]
        #: What decides on a run's bucket.
        self.deal = self.key

    def _runs(self) -> None:
        n = len(self.data)
        self.start = self.count = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < WIDTH:
            return
        wide = np.concatenate([self.data, np.zeros(GRAM, np.uint8)])
        word = np.ndarray((n + GRAM - 8 + 1,), "<u8", wide.data, 0, (1,))
        m = mixed(word[:n] * _A + word[8 : n + 8] * _B + word[GRAM - 8 : n + GRAM - 8] * _C)
        windows = n - WIDTH + 1
        self._gram = m
        m = slid(m, WIDTH - GRAM + 1, np.minimum)[:windows]
        inside = np.zeros(n + 1, np.int8)  # windows that end in the document they start in
        last = self.ends - WIDTH + 1
        full = last > self.begins
        np.add.at(inside, self.begins[full], 1)
        np.add.at(inside, last[full], -1)
        inside = np.cumsum(inside[:windows], dtype=np.int8) > 0
        change = np.ones(windows + 1, bool)
        change[1:windows] = (m[1:] != m[:-1]) | (inside[1:] != inside[:-1])
        first = np.zeros(n + 1, bool)
        first[self.begins[self.begins < n]] = True
        change[:windows] |= first[:windows]
        edges = np.flatnonzero(change)
        start, count = edges[:-1], np.diff(edges)
        ok = inside[start]
        self.start, self.count = start[ok], count[ok]
        self.key = m[self.start]
        self.doc = np.searchsorted(self.ends, self.start, "right")

    def divide(self, hot: np.ndarray) -> None:
        """Runs that are ``hot`` in pieces, by the anchor's place in their windows and the bytes that all windows with it there share."""
        which = np.flatnonzero(hot)
        if not len(which):
            return
        start, count = self.start[which], self.count[which]
        # the first place of the anchor at or after each window's start: the nearest from the right, run by run
        reach = count + WIDTH - GRAM
        run = np.repeat(np.arange(len(which)), reach)
        at = np.arange(len(run)) - np.repeat(np.cumsum(reach) - reach, reach) + start[run]
        far = np.int64(1) << 40
        hits = np.where(self._gram[at] == self.key[which][run], run * far + at, np.iinfo(np.int64).max)
        first = np.minimum.accumulate(hits[::-1])[::-1] - run * far
        window = at < start[run] + count[run]
        at, run, first = at[window], run[window], first[window]
        group = (first - at) // PLACES
        begin = first - PLACES * group
        shared = Rolling(_BYTE[self.data], 2).of(np.maximum(begin, 0), np.minimum(begin + WIDTH - PLACES + 1, len(self.data)))
        deal = mixed(shared ^ group.astype(np.uint64) * _C)
        edge = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (deal[1:] != deal[:-1])]))
        cold = np.flatnonzero(~hot)
        piece = which[run[edge]]
        self.deal = np.concatenate([self.key[cold], deal[edge]])
        self.start, self.count = np.concatenate([self.start[cold], at[edge]]), np.concatenate([self.count[cold], np.diff(np.append(edge, len(at)))])
        self.doc, self.key, self.owner = (np.concatenate([x[cold], x[piece]]) for x in (self.doc, self.key, self.owner))

    def content(self, runs: np.ndarray) -> list[np.ndarray]:
        """128 bits for the bytes of each run, length included."""
        s = self.start[runs]
        e = s + self.count[runs] + WIDTH - 1
        values = _BYTE[self.data]
        return [Rolling(values, k).of(s, e) for k in (0, 1)]


class Groups(NamedTuple):
    """Runs of a chunk under recurring anchors, equal ones together."""

    order: np.ndarray  # the runs
    lead: np.ndarray  # where each group starts in ``order``
    one: np.ndarray  # 128 bits of each group's content
    two: np.ndarray
    least: np.ndarray  # smallest and largest doc_id
    most: np.ndarray


def _groups(c: Chunk, key: np.ndarray, often: np.ndarray, hot: np.ndarray) -> Groups:
    """Flags are of the chunk's distinct keys."""
    if len(key):
        c.divide(hot[np.searchsorted(key, c.key)])
    runs = np.flatnonzero(often[np.searchsorted(key, c.key)]) if len(key) else np.zeros(0, np.int64)
    one, two = c.content(runs)
    order = np.lexsort((two, one))
    runs, one, two = runs[order], one[order], two[order]
    if not len(runs):
        return Groups(runs, runs, one, two, runs, runs)
    at = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    return Groups(runs, at, one[at], two[at], np.minimum.reduceat(c.owner[runs], at), np.maximum.reduceat(c.owner[runs], at))


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all [start, start + length), end to end."""
    total = int(length.sum())
    at = np.repeat(start - np.cumsum(length) + length, length)
    return data[at + np.arange(total)] if total else np.zeros(0, np.uint8)


def _keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    c = Chunk(table)
    return c.key, c.owner


def _send_runs(buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, chunk = [], None
        if left.num_rows and right.num_rows:
            chunk, c = left.column("chunk")[0].as_py(), Chunk(left)
            key, _ = distinct_keys(c.key, c.owner)
            often, hot = recurring(key, buckets, right)
            g = _groups(c, key, often, hot)
            heads = g.order[g.lead]
            for b, x in split(bucket_of(c.deal[heads], buckets)):
                r = heads[x]
                text = _gathered(c.data, c.start[r], c.count[r] + WIDTH - 1)
                rows.append((b, packed(planes(c.count[r].astype(np.int32)), planes(g.least[x]), planes(g.most[x] - g.least[x]), text), None))
            if rows:
                rows.append((chunk % buckets, None, np.packbits(np.concatenate([often, hot])).tobytes()))
        return rows_of(RUNS, bucket=[r[0] for r in rows], chunk=[chunk] * len(rows), blob=[r[1] for r in rows], note=[r[2] for r in rows])

    return send


def _indexed(begin: np.ndarray, count: np.ndarray, owner: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Smallest owner of each window of the runs (by ascending owner), run after run; a batch of windows is copied at a time."""
    edge = np.concatenate([[0], np.cumsum(count)])
    out, index = np.empty(int(edge[-1]), np.int64), LogIndex(WIDTH, BATCH)
    view = np.lib.stride_tricks.sliding_window_view(text, WIDTH)
    for at in range(0, len(out), BATCH):
        w = np.arange(at, min(at + BATCH, len(out)))
        run = np.searchsorted(edge, w, "right") - 1
        out[at : at + BATCH] = index.add(view[begin[run] + w - edge[run]], owner[run])
    return out


def _received(blob: bytes) -> tuple[np.ndarray, ...]:
    """Runs of a chunk: 128 bits of each's content, number of windows, smallest and largest owner, text."""
    *numbers, text = unpacked(blob, "u1", "u1", "u1", "u1")
    count, least, more = (of_planes(x, kind) for x, kind in zip(numbers, ("<i4", "<i8", "<i8"), strict=True))
    count = count.astype(np.int64)
    e = np.cumsum(count + WIDTH - 1)
    one, two = (Rolling(_BYTE[text], k).of(e - count - WIDTH + 1, e) for k in (0, 1))
    return one, two, count, least, least + more, text


def _least_owners(table: pa.Table) -> pa.Table:
    """For each chunk: stretches (number of the run as it was sent, offset, size, owner) of windows that a document with a smaller id than the run's largest has."""
    bucket = table.column("bucket")[0].as_py()
    chunks, notes = (table.column(c).to_pylist() for c in ("chunk", "note"))
    rows = [(k, None, n) for k, n in zip(chunks, notes, strict=True) if n is not None]
    sent = [(k, _received(b.as_py())) for k, b in zip(chunks, table.column("blob"), strict=True) if b.is_valid]
    if sent:
        one, two, count, owner, most, text = (np.concatenate([x[k] for _, x in sent]) for k in range(6))
        sent = [(k, len(x[0])) for k, x in sent]
        begin = np.cumsum(count + WIDTH - 1) - count - WIDTH + 1
        # the same run from several chunks: windows are indexed once, with the smallest owner
        order = np.lexsort((owner, count, two, one))
        lead = np.ones(len(order), bool)
        lead[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (count[order][1:] != count[order][:-1])
        head = np.empty(len(order), np.int64)
        head[order] = order[lead][np.cumsum(lead) - 1]
        fed = order[lead]
        fed = fed[np.argsort(owner[fed], kind="stable")]
        flat = _indexed(begin[fed], count[fed], owner[fed], text)
        place = np.empty(len(order), np.int64)
        place[fed] = np.cumsum(count[fed]) - count[fed]
        edge = np.cumsum([0] + [n for _, n in sent])
        for (k, _), s, e in zip(sent, edge[:-1], edge[1:], strict=True):
            n = count[s:e]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            who = flat[np.repeat(place[head[s:e]], n) + offset]
            useful = np.repeat(most[s:e], n) > who
            change = np.ones(len(who), bool)
            change[1:] = (who[1:] != who[:-1]) | (useful[1:] != useful[:-1])
            change |= offset == 0
            at = np.flatnonzero(change)
            size = np.diff(np.append(at, len(who)))
            at, size = at[useful[at]], size[useful[at]]
            if len(at):
                run = np.searchsorted(np.cumsum(n), at, "right")
                rows.append((k, packed(run.astype(np.int32), offset[at].astype(np.int32), size.astype(np.int32), who[at]), None))
    return rows_of(RUNS, bucket=[bucket] * len(rows), chunk=[r[0] for r in rows], blob=[r[1] for r in rows], note=[r[2] for r in rows])


def _removed(c: Chunk, right: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    n = len(c.data)
    cover = np.zeros(n + 1, np.int32)
    note, blobs = None, {}
    for b, blob, x in zip(*(right.column(k).to_pylist() for k in ("bucket", "blob", "note")), strict=True):
        if x is None:
            blobs[b] = blob
        else:
            note = x
    if note is not None and blobs:
        key, _ = distinct_keys(c.key, c.owner)
        flags = np.unpackbits(np.frombuffer(note, np.uint8))[: 2 * len(key)].astype(bool)
        g = _groups(c, key, flags[: len(key)], flags[len(key) :])
        got = [(x, unpacked(blobs[b], "i4", "i4", "i4", "i8")) for b, x in split(bucket_of(c.deal[g.order[g.lead]], buckets)) if b in blobs]
        group = np.concatenate([x[a[0]] for x, a in got])
        offset, size, who = (np.concatenate([a[k] for _, a in got]).astype(np.int64) for k in (1, 2, 3))
        # every run of a group takes the stretches of its group
        last = np.append(g.lead[1:], len(g.order))
        many = last[group] - g.lead[group]
        at = np.repeat(np.arange(len(group)), many)
        run = g.order[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + g.lead[group[at]]]
        ok = who[at] < c.owner[run]
        run, at = run[ok], at[ok]
        begin = c.start[run] + offset[at]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size[at] + WIDTH - 1, -1)
    return np.cumsum(cover[:n]) > 0


def _edges(c: Chunk, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs, documents apart."""
    if not len(gone):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(gone) + 1, bool)
    border[c.begins[c.begins < len(gone)]] = True
    before = np.concatenate([[False], gone[:-1]])
    after = np.concatenate([gone[1:], [False]])
    return np.flatnonzero(gone & (~before | border[:-1])), np.flatnonzero(gone & (~after | np.concatenate([border[1:-1], [True]]))) + 1


def _digests(c: Chunk, gone: np.ndarray) -> pa.Table:
    starts, _ = _edges(c, gone)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[c.ends] - total[c.begins]
    spans = np.searchsorted(starts, c.ends) - np.searchsorted(starts, c.begins)
    sha = []
    for s, e, r in zip(c.begins.tolist(), c.ends.tolist(), removed.tolist(), strict=True):
        x = c.data[s:e]
        sha.append(hashlib.sha256(x[~gone[s:e]] if r else x).hexdigest())
    return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "n_bytes": pa.array(c.ends - c.begins), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())})


def _span_rows(c: Chunk, gone: np.ndarray) -> pa.Table:
    starts, ends = _edges(c, gone)
    lo, hi = np.searchsorted(starts, c.begins), np.searchsorted(starts, c.ends)
    cols = [[], [], [], []]
    for k, (s, e) in enumerate(zip(c.begins.tolist(), c.ends.tolist(), strict=True)):
        cols[0].append(None if c.null[k] else int(c.ids[k]))
        cols[1].append(c.data[s:e][~gone[s:e]].tobytes())
        cols[2].append((starts[lo[k] : hi[k]] - s).tolist())
        cols[3].append((ends[lo[k] : hi[k]] - s).tolist())
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("doc_id", "text_bytes", "starts", "ends"), cols, kinds, strict=True)})


def _finish(buckets: int, make):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        out = make(c, _removed(c, right, buckets))
        return out.filter(pa.array(~c.accepted)) if "accepted" in left.column_names else out

    return finish


def _applied(docs: DataFrame, earlier: DataFrame | None, make, schema: str) -> DataFrame:
    buckets = BUCKETS * parts(docs.sparkSession)
    if earlier is not None:
        mark = lambda df, x: df.select("doc_id", "text", F.lit(x).alias("accepted"))
        docs = mark(docs, False).unionByName(mark(earlier, True))
    chunks = dealt_by_text(docs, CHUNK_BYTES, *["accepted"] * (earlier is not None)).groupBy("chunk")
    often = chunks.applyInArrow(send_keys(_keys_of, buckets), BLOBS).groupBy("bucket").applyInArrow(common, BLOBS)
    runs = chunks.cogroup(often.groupBy("chunk")).applyInArrow(_send_runs(buckets), RUNS)
    found = runs.groupBy("bucket").applyInArrow(_least_owners, RUNS)
    return chunks.cogroup(found.groupBy("chunk")).applyInArrow(_finish(buckets, make), schema)


def dedup_spans(docs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Per document: the bytes that stay, and starts and ends of the removed runs."""
    return _applied(docs, earlier, _span_rows, SPANS)


def dedup_digests(docs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, earlier, _digests, RESULT)
