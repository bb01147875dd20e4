"""Packing into token windows by Karmarkar-Karp multiway differencing (operator 7).

Every whole text is encoded, with one end id after it. Full windows are cut off a
document first; what is left is cut into near-equal pieces of at most ``PIECE`` ids and
a short last one of ``TAIL``, which gives the differencing small change. Pieces are dealt at random (by row number) into groups of about ``GROUP`` windows' worth. In a
group, largest differencing keeps partial partitions into w windows, and merges the two
with the largest spreads by adding the opposite ends, which leaves near-equal windows.
w starts at the fewest windows that could hold the ids and rises whenever the fullest
window exceeds its capacity. Groups are bounded, so tasks are, at any input size.

Only piece descriptions are shuffled (about 60 bytes each); ids are reduced to their
CRC-32 where they are made, or returned by :func:`encoded` for writers.

Edge cases: a null or empty text is the end id alone; a null doc_id is carried along;
repeated rows are packed one by one; very long texts fill windows of their own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepared

CAPACITY, PIECE, TAIL, GROUP, END_ID = 2048, 512, 64, 512, 1
#: Texts that both libraries are known to split alike; others take the slower one.
_PLAIN = re.compile(r"[\x00-˿‐-‧€]*\Z")
_LONG_RUN = re.compile(r"\S{5000}")
MADE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """ids of byte_bpe_50k.json; the same vocabulary's rank file serves where both are known to agree, several times faster."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.full, self.fast = Tokenizer.from_file(json_path), None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and "<|endoftext|>" not in text and _PLAIN.match(text) and not _LONG_RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def paths() -> tuple[str, str]:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, near-equal pieces of the rest, a short last piece."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at, rest = len(out) * capacity, n % capacity
    if rest:
        out.append((n - min(rest, TAIL), min(rest, TAIL)))
        rest -= min(rest, TAIL)
    k = -(-rest // piece)
    for i in range(k):
        size = rest // k + (i < rest % k)
        out.append((at, size))
        at += size
    return out


def _made(vocabulary, capacity: int, piece: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*(vocabulary or paths()))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols = [[] for _ in range(6)]
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for s, n in cuts(len(ids), capacity, piece):
                    for c, v in zip(cols, (i, s, n, zlib.crc32(ids[s : s + n]), len(ids), row), strict=True):
                        c.append(v)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return made


def encoded(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and ids (end id included) for each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*(vocabulary or paths()))
        for batch in batches:
            ids = [np.append(enc(x.as_py()), END_ID).astype(np.int32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return prepared(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def differenced(sizes: np.ndarray, w: int) -> tuple[list[list[int]], np.ndarray]:
    """Karmarkar-Karp: the items of each of w windows, and the windows' sums."""
    order = np.argsort(-sizes, kind="stable")
    state: list[tuple[np.ndarray, list]] = []
    # w items at a time are one partial partition: an item each, which is how largest differencing starts on sorted items
    for at in range(0, len(order), w):
        mine = order[at : at + w]
        sums = np.zeros(w, np.int64)
        sums[: len(mine)] = sizes[mine]
        state.append((sums, [[int(i)] for i in mine] + [[] for _ in range(w - len(mine))]))
    heap = [(int(s[-1] - s[0]), k) for k, (s, _) in enumerate(state)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ia), (sb, ib) = state[a], state[b]
        sums = sa + sb[::-1]
        order = np.argsort(-sums, kind="stable")
        items = [ia[k] + ib[w - 1 - k] for k in range(w)]
        state.append((sums[order], [items[k] for k in order]))
        heapq.heappush(heap, (int(sums.min() - sums.max()), len(state) - 1))
    sums, items = state[heap[0][1]]
    return items, sums


def packed(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of windows that hold at most ``capacity`` each."""
    w = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        items, sums = differenced(sizes, w)
        if sums.max() <= capacity:
            return [x for x in items if x]
        w += max(1, w // 200)


def _grouped(capacity: int):
    def grouped(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes = table.column("length").to_numpy()
        whole = np.flatnonzero(sizes == capacity)
        rest = np.flatnonzero(sizes < capacity)
        windows = [[int(k)] for k in whole]
        if len(rest):
            windows += [[int(rest[k]) for k in sorted(x)] for x in packed(sizes[rest], capacity)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        group = table.column("group")[0].as_py()
        for k, x in enumerate(windows):
            sequence[x] = (group << 24) + k
            offset[x] = np.cumsum(sizes[x]) - sizes[x]
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return grouped


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``vocabulary``: paths of the JSON and the rank file on the executors."""
    pieces = cut(prepared(docs).mapInArrow(_made(vocabulary, capacity, min(PIECE, capacity)), MADE))
    groups = max(1, round((pieces.agg(F.sum("length")).first()[0] or 0) / (GROUP * capacity)))
    return pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(_grouped(capacity), PIECES)
