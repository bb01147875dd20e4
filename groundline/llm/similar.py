"""Near duplicates by the similarity of word shingles: every pair of at least a given Jaccard similarity is linked, and no other.

The method is operator 5's, SimHash with pivot distance tables, at a wider radius.
Fingerprints have ``BITS`` bits: a bit is set if it is set in over half of the hashes of a
text's shingles. Pairs that share a bucket are held against a pivot table, the Hamming
distances to members of the bucket: a pair whose distances to any pivot differ by more
than the radius is discarded (triangle inequality). The distance of the rest is computed,
and what is within the radius is verified on the whole sets of 64-bit shingle hashes, so
no pair below the threshold is linked. The radius (``radius``) is what a pair at the
threshold exceeds with a probability of at most ``MISSED``.

No choice of blocks of a fingerprint can serve as buckets here: texts that share 0.8 of
their shingles differ in 15 % of the bits, so that such a pair shares 24 bits in one of 50
choices. Buckets are bands of ``HASHES`` min-hashes, so many a band (``rows_for``) that a
pair at the threshold shares none with a probability below ``MISSED`` (at 0.8: bands of
4, one pair in 20 million).

Texts with equal sets are one node. Up to ``SMALL`` nodes of a bucket are paired with each
other, those of a larger bucket with its smallest node only. These candidates are verified
in two rounds: each node's nearest by fingerprint first, then all pairs that are still in
different components. Then larger buckets whose nodes are in different components are
searched whole: members that have a pair within the radius get their sets, and one task
verifies all such pairs of a bucket but those that its links have connected already, and
returns a spanning forest. So rows grow with the members of a group, never with its pairs,
and no pair is left out. The sets of all nodes in candidates and larger buckets are made
once; texts move for that only.

Edge cases: a text without words has the set of one constant, so such texts are equal;
fewer words than a shingle has make one shingle; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, sliced
from .components import components
from .units import named

HASHES, MISSED, SMALL = 128, 1e-6, 8
#: Bits of a fingerprint, and pivots of a larger bucket.
BITS, PIVOTS = 256, 8
#: Pairs that are verified at once.
BLOCK = 1 << 12
_rng = np.random.default_rng(58003)
_SALTS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_SIGNS = _rng.integers(1, 1 << 63, (2, BITS // 64), dtype=np.uint64) | np.uint64(1)
ROWS = "id long, th long, node long, n int, sketch binary, bands binary"
FOUND = "bucket long, u long, v long, bits int, n int, sketch binary"
MEMBERS = "bucket long, u long, n int, sketch binary, root long"
#: An entry of a bucket: a set's bands each have one.
ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("sketch", "<u8", BITS // 64), ("n", "<i4")])


def rows_for(similarity: float) -> int:
    """Hashes of a band: as many as leave pairs at the threshold together in some band."""
    return max(r for r in range(1, 17) if r == 1 or (1 - similarity**r) ** (HASHES // r) <= MISSED)


def _differing(c: int, x: int, y: int) -> float:
    """Probability that a bit differs between sets that share c shingles and have x and y more."""
    some = lambda n: np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n
    s = np.arange(c + 1)[:, None]
    p, q = ((some(n) * (2 * (s + np.arange(n + 1)) > c + n)).sum(1) for n in (x, y))
    return float((some(c) * (p * (1 - q) + q * (1 - p))).sum())


@lru_cache
def radius(similarity: float) -> int:
    """Bits in which fingerprints of a pair at the threshold may differ; for small sets, whose bits differ more often than by the angle between large ones, as counted."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    for union in range(2, 41):
        c = max(1, int(np.ceil(similarity * union - 1e-9)))
        p = max([p, *(_differing(c, x, union - c - x) for x in range((union - c) // 2 + 1))])
    over, t = 1.0, -1
    while over > MISSED and t < BITS:
        t += 1
        over -= comb(BITS, t) * p**t * (1 - p) ** (BITS - t)
    return t


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([h(flat[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))  # noqa: B905  shingles are fewer than words


def bands(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Hashes of the bands of each set; one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat(_mixed((flat ^ salt) * odd), starts) for salt, odd in zip(_SALTS, _ODD, strict=True)], 1)
    keys = np.tile(np.arange(1, HASHES // rows + 1, dtype=np.uint64), (len(sets), 1))
    for k in range(rows):
        keys = _mixed(keys ^ least[:, k : HASHES // rows * rows : rows])
    return keys


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes: ``BITS`` bits, each set if it is set in over half of the (salted) hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        salted = _mixed((hashes[at : at + (1 << 13), None] ^ _SIGNS[0]) * _SIGNS[1])
        ones += np.unpackbits(salted.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _rows(shingle: int, per: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            found = [shingle_set(x.as_buffer().to_pybytes(), shingle) for x in batch.column("bytes")]
            node = [xxhash.xxh64_intdigest(x.tobytes(), 7) >> 1 for x in found]
            keys, sketch = bands(found, per), [fingerprint(x) for x in found]
            cols = [pa.array(node, pa.int64()), pa.array([len(x) for x in found], pa.int32()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (sketch, keys))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *cols], names=["id", "th", "node", "n", "sketch", "bands"])

    return rows


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingle_set(x.as_buffer().to_pybytes(), shingle).tobytes() for x in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    return sets


def _sketches(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), "<u8") for x in column]).reshape(-1, BITS // 64)


def _deal(parts_: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("bands")])
            entry = np.empty(keys.shape, ENTRY)
            entry["key"] = keys
            entry["node"], entry["n"] = (batch.column(c).to_numpy()[:, None] for c in ("node", "n"))
            entry["sketch"] = _sketches(batch.column("sketch"))[:, None, :]
            entry = entry.ravel()
            to = (entry["key"] % np.uint64(parts_)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, entry = to[order], entry[order]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            blobs = [entry[s:e].tobytes() for s, e in zip(edge, [*edge[1:], len(to)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[edge]), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return deal


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x["sketch"] ^ y["sketch"]).sum(-1, dtype=np.int16)


def _sized(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of entries can have the similarity by the sizes of their sets."""
    return np.minimum(x["n"], y["n"]) >= similarity * np.maximum(x["n"], y["n"]) - 1e-9


def _candidates(similarity: float):
    def candidates(table: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("blob")])
        entry = entry[np.lexsort((entry["node"], entry["key"]))]
        node, key = entry["node"], entry["key"]
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(lead, len(key)))
        bucket = np.repeat(np.arange(len(lead)), count)
        found, most = [np.zeros((0, 3), np.int64)], radius(similarity)
        pivot = _distance(entry, entry[lead[bucket]])  # a bucket's first node is its pivot

        def pair(a: np.ndarray, b: np.ndarray) -> None:
            kept = (np.abs(pivot[a] - pivot[b]) <= most) & _sized(entry[a], entry[b], similarity)
            a, b = a[kept], b[kept]
            bits = _distance(entry[a], entry[b])
            near = bits <= most
            found.append(np.stack([node[a[near]], node[b[near]], bits[near]], 1))

        for lag in range(1, SMALL):
            a = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & (count[bucket[lag:]] <= SMALL))
            pair(a, a + lag)
        large = np.flatnonzero(count[bucket] > SMALL)
        first = lead[bucket[large]]
        pair(first[large != first], large[large != first])
        pairs, many = np.unique(np.concatenate(found), axis=0), entry[large]
        columns = {
            "bucket": (pa.nulls(len(pairs), pa.int64()), pa.array(many["key"].astype(np.int64))), "u": (pa.array(pairs[:, 0]), pa.array(many["node"].copy())), "v": (pa.array(pairs[:, 1]), pa.nulls(len(many), pa.int64())),
            "bits": (pa.array(pairs[:, 2].astype(np.int32)), pa.nulls(len(many), pa.int32())), "n": (pa.nulls(len(pairs), pa.int32()), pa.array(many["n"].copy())), "sketch": (pa.nulls(len(pairs), pa.binary()), pa.array([x.tobytes() for x in many["sketch"]], pa.binary())),
        }
        return pa.table({name: pa.concat_arrays(x) for name, x in columns.items()})

    return candidates


def pivot_table(entry: np.ndarray, most: int) -> np.ndarray:
    """Distances of a bucket's entries to up to ``PIVOTS`` of them, each the farthest from those before; none within ``most`` of another."""
    table = [_distance(entry, entry[:1])]
    while len(table) < PIVOTS and (away := np.min(table, axis=0)).max(initial=0) > most:
        table.append(_distance(entry, entry[[away.argmax()]]))
    return np.stack(table, 1)


def searched(entry: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each entry of a bucket with those that it can be similar to and whose root (which may change meanwhile) is another; every pair once."""
    most = radius(similarity)
    table = pivot_table(entry, most)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    until = np.searchsorted(first, first + most, "right")
    for i, k in enumerate(order.tolist()):
        other = order[i + 1 : until[i]]
        other = other[root[other] != root[k]]
        other = other[(np.abs(table[other, 1:] - table[k, 1:]) <= most).all(1)]
        other = other[_sized(entry[other], entry[k], similarity)]
        other = other[_distance(entry[other], entry[k]) <= most]
        if len(other):
            yield k, other


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    entry = np.zeros(table.num_rows, ENTRY)
    entry["node"], entry["n"], root = (table.column(c).to_numpy() for c in ("u", "n", "root"))
    entry["sketch"] = _sketches(table.column("sketch"))
    return entry, root


def _meeting(similarity: float):
    """The members of a bucket that have a pair to verify."""

    def meeting(table: pa.Table) -> pa.Table:
        entry, root = _members(table)
        meets = np.zeros(len(entry), bool)
        for k, other in searched(entry, root, similarity):
            meets[k] = True
            meets[other] = True
        return table.filter(pa.array(meets))

    return meeting


def _linked(similarity: float):
    """Links (u, v) between a bucket's components, over all its pairs: a spanning forest."""

    def linked(table: pa.Table) -> pa.Table:
        entry, root = _members(table)
        root = root.copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        _, flat, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        size = np.array([len(x) for x in sets])
        ends = np.cumsum(size)
        mark, links = np.zeros(len(seen), bool), []
        for k, others in searched(entry, root, similarity):
            mine = flat[ends[k] - size[k] : ends[k]]
            mark[mine] = True
            for at in range(0, len(others), BLOCK):
                other = others[at : at + BLOCK]
                edge = np.concatenate([[0], np.cumsum(size[other])])
                hit = mark[flat[np.arange(edge[-1]) + np.repeat(ends[other] - edge[1:], size[other])]]
                both = np.diff(np.concatenate([[0], np.cumsum(hit)])[edge])
                for j in other[both >= similarity * (size[k] + size[other] - both) - 1e-9].tolist():
                    if root[j] != root[k]:
                        root[root == root[j]] = root[k]
                        links.append((k, j))
            mark[mine] = False
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(entry["node"][u]), "v": pa.array(entry["node"][v])})

    return linked


def _verified(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return verified


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that are similar. Merge joins at any size: what is moved then grows with the input, and a hot node is split."""
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("hashes").alias(name)).hint("merge")
    return pairs.join(of("u", "x"), "u").join(of("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(_verified(similarity), "u long, v long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (u, v, bits) whose ends are in different components; ``roots``: (node, root) of nodes that aren't their own."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    both = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return both.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "bits")


def _connected(pairs: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) after all links among the candidates (u, v, bits) have been added to those that ``roots`` says."""
    pairs = cut(pairs.groupBy("u", "v").agg(F.min("bits").alias("bits")))
    if pairs.isEmpty():
        return roots
    # the nearest smaller node of each
    chosen = cut(pairs.groupBy("v").agg(F.min(F.struct("bits", "u")).alias("best")).select("best.u", "v"))
    roots = _joined(roots, _verify(chosen, sets, similarity))
    rest = cut(_apart(pairs.join(chosen, ["u", "v"], "left_anti"), roots), pairs, chosen)
    return roots if rest.isEmpty() else _joined(roots, _verify(rest.select("u", "v"), sets, similarity))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)))


def near_duplicates(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """id, th, component for each row: its name (``units``) and a number that all rows linked to it share."""
    texts = named(docs).select("id", "th", F.col("text").cast("binary").alias("bytes"))
    rows = cut(texts.mapInArrow(_rows(shingle, rows_for(similarity)), ROWS))
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "bands")])
    dealt = nodes.mapInArrow(_deal(4 * parts(docs.sparkSession)), "part long, blob binary")
    found = cut(dealt.groupBy("part").applyInArrow(_candidates(similarity), FOUND))
    rows = cut(rows.select("id", "th", "node"), rows)
    wanted = found.select(F.col("u").alias("node")).union(found.where("bucket IS NULL").select("v")).distinct()
    where = cut(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "th")).alias("at")).select("node", "at.id", "at.th"))
    # rows that are equal in id and th, and so in text, lie in one partition here; one gives the set
    sets = texts.join(where.hint("merge"), ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "bytes").mapInArrow(_sets(shingle), "node long, hashes binary")
    sets = cut(sets, where)
    roots = _connected(found.where("bucket IS NULL").select("u", "v", "bits"), docs.sparkSession.createDataFrame([], "node long, root long"), sets, similarity)
    members = found.where("bucket IS NOT NULL").join(roots, F.col("u") == F.col("node"), "left").select("bucket", "u", "n", "sketch", F.coalesce("root", "u").alias("root"))
    split = members.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    left = cut(members.join(split, "bucket", "left_semi").groupBy("bucket").applyInArrow(_meeting(similarity), MEMBERS))
    if not left.isEmpty():
        whole = left.join(sets.hint("merge"), F.col("u") == F.col("node")).select("bucket", "u", "n", "sketch", "root", "hashes")
        roots = _joined(roots, whole.groupBy("bucket").applyInArrow(_linked(similarity), "u long, v long"))
    return rows.join(roots, "node", "left").select("id", "th", F.coalesce("root", "node").alias("component"))
