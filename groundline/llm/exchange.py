"""How chunks of documents learn which of their keys other documents have, without moving texts.

Texts are dealt to chunks once. A chunk sends five bytes for each distinct key to the
key's bucket and gets two bits back: whether two documents have it, and whether it is hot
(``HOT`` chunks or more have it). Equal short keys are only candidates; what is sent next
is compared in full.

The number of chunks follows the bytes of text, that of buckets the session's shuffle
partitions. A key that all documents have costs its bucket one entry for each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, prepared

BLOBS = "bucket long, chunk long, blob binary"
HOT = 64


def dealt(docs: DataFrame, chunk_bytes: int, *more: str) -> DataFrame:
    """doc_id, the named columns, bytes, chunk: as many chunks as ``chunk_bytes`` of text each make."""
    base = prepared(docs, *more).select("doc_id", *more, F.col("text").cast("binary").alias("bytes"))
    size = base.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "bytes"), F.lit(max(1, -(-size // chunk_bytes)))))


def dealt_by_text(docs: DataFrame, chunk_bytes: int, *more: str) -> DataFrame:
    """As ``dealt``, but equal texts share a chunk, which tells their keys and stretches once. Only texts whose copies have more than a quarter of a chunk's bytes are dealt to as many chunks as that takes."""
    base = prepared(docs, *more).select("doc_id", *more, F.col("text").cast("binary").alias("bytes"))
    size, th, quarter = F.octet_length("bytes"), F.xxhash64("bytes"), max(1, chunk_bytes // 4)
    texts = cut(base.groupBy(th.alias("hot")).agg(F.sum(size).alias("all"), F.max(size).alias("each")))
    chunks = max(1, -(-(texts.agg(F.sum("all")).first()[0] or 0) // chunk_bytes))
    # at most four for each chunk
    hot = cut(texts.where((F.col("all") > quarter) & (F.col("all") > F.col("each"))).select("hot", F.ceil(F.col("all") / quarter).alias("shares")), texts)
    if hot.isEmpty():
        return base.withColumn("chunk", F.pmod(th, F.lit(chunks)))
    share = F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("doc_id"), "shares"))
    out = base.withColumn("th", th).join(F.broadcast(hot), F.col("th") == F.col("hot"), "left")
    return out.select("doc_id", *more, "bytes", F.pmod(F.when(share.isNull(), F.col("th")).otherwise(F.xxhash64("th", share)), F.lit(chunks)).alias("chunk"))


def owners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row's document (its doc_id; without one, the last), and which have none."""
    ids = table.column("doc_id").combine_chunks()
    return ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null())


def buffers(table: pa.Table) -> list[pa.Buffer]:
    return [x.as_buffer() for col in table.column("bytes").chunks for x in col]


def packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(b := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + b for a in arrays)
    return len(raw).to_bytes(8, "little") + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def planes(x: np.ndarray) -> np.ndarray:
    """The lowest byte of all numbers, then the next of all: small numbers compress to their low bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T


def of_planes(x: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(x.reshape(width, -1).T).view(kind).ravel()


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def rows_of(schema: str, **cols) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({c: pa.array(cols[c], kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def split(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places in order) for each bucket in ``to``."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order])) + 1
    return [(int(to[x[0]]), x) for x in np.split(order, edge) if len(x)]


def _short(key: np.ndarray) -> np.ndarray:
    """40 bits of a key within its bucket."""
    return (key ^ (key >> np.uint64(3))) & np.uint64((1 << 40) - 1)


def distinct_keys(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether two documents have each."""
    if not len(key):
        return key, np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)


def sorted_places(key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """For each bucket the places of a chunk's distinct keys, in the order in which they are sent."""
    low = _short(key)
    return [(b, x[np.argsort(low[x], kind="stable")]) for b, x in split(bucket_of(key, buckets))]


def send_keys(keys_of, buckets: int):
    """``keys_of``: (key, owner) of a chunk's table."""

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        key, multi = distinct_keys(*keys_of(table))
        rows = []
        for b, x in sorted_places(key, buckets):
            five = _short(key[x]).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((b, chunk, packed(five, np.packbits(multi[x]))))
        return rows_of(BLOBS, bucket=[r[0] for r in rows], chunk=[r[1] for r in rows], blob=[r[2] for r in rows])

    return send


def common(table: pa.Table) -> pa.Table:
    """Which keys of each chunk two documents have, and which are hot: one bit each, in the chunk's order."""
    bucket = table.column("bucket")[0].as_py()
    chunks, lows, multis = table.column("chunk").to_pylist(), [], []
    for blob in table.column("blob"):
        five, bits = unpacked(blob.as_py(), "u1", "u1")
        n = len(five) // 5
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = five.reshape(n, 5)
        lows.append(wide.view("<u8").ravel())
        multis.append(np.unpackbits(bits)[:n].astype(bool))
    low, multi = np.concatenate(lows), np.concatenate(multis)
    _, at, seen = np.unique(low, return_inverse=True, return_counts=True)
    often = seen > 1
    often[at[multi]] = True
    edges = np.cumsum([len(x) for x in lows])[:-1]
    flags = zip(np.split(often[at], edges), np.split((seen >= HOT)[at], edges), strict=True)
    return rows_of(BLOBS, bucket=[bucket] * len(chunks), chunk=chunks, blob=[np.packbits(np.concatenate(x)).tobytes() for x in flags])


def recurring(key: np.ndarray, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct keys of a chunk two documents have, and which are hot, from the answers (bucket, blob) to it."""
    out, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    bits = {b: blob.as_py() for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob"), strict=True)}
    for b, x in sorted_places(key, buckets):
        if b in bits:
            flags = np.unpackbits(np.frombuffer(bits[b], np.uint8))[: 2 * len(x)].astype(bool)
            out[x], hot[x] = flags[: len(x)], flags[len(x) :]
    return out, hot
