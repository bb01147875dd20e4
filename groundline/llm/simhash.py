"""SimHash near-dedup with pivot distance tables (operator 5).

Fingerprints: a bit is set if it is set in over half of the XXH64 values of a text's word
shingles. Documents with equal fingerprints meet by aggregation; the search below sees
each distinct fingerprint once.

Search: fingerprints that differ in ``MOST`` = 3 bits or fewer are equal in at least b - 3
of any b blocks of bits, so every such pair shares a bucket (chosen blocks, their bits).
Within a bucket, a table of Hamming distances to ``PIVOTS`` reference fingerprints
discards the pairs whose coordinates differ by more than 3 anywhere (triangle
inequality; the bucket is swept in the order of the first coordinate), and the survivors
are verified by their real distance. b follows the number of fingerprints (4 to 6), so
buckets stay small at any size. A bucket that is large all the same is divided again, by
the blocks of the bits outside its key, before pairs are formed. A crowd (more than
``CROWD`` in a bucket) leaves its task: it is dealt anew by cells of the first ``AXES``
coordinates of its pivot table, ``CELL`` wide and overlapping by the tolerance, so that
every pair that the table doesn't discard shares a cell. Each task returns a spanning
forest of the links it has verified, never all pairs of a group.

Components of fingerprints are then found by star contraction (``components``), and each
takes its smallest doc_id.

Edge cases: a text without words (null, empty) has fingerprint zero and is linked like
any other; fewer words than a shingle has make one shingle; a null doc_id ranks last,
so component_id is null only where a component has no other; doc_ids are any longs; rows that repeat a doc_id share a component only if their texts are linked, or other
texts link both; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import cut, parts, prepared, rank_of
from .components import components
from .units import named

SHINGLE, MOST, PIVOTS = 3, 3, 48
#: Fingerprints of a bucket above which it is divided again, and above which it is a crowd.
LARGE, CROWD = 512, 1 << 13
AXES, CELL = 4, 4
#: Pairs whose links are reduced to a forest at once.
PAIRS = 1 << 20


def _pivots() -> np.ndarray:
    """Reference fingerprints by the splitmix64 rule."""
    x = (np.arange(1, PIVOTS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(flat, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(flat[s:e], 42) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)  # noqa: B905  shingles are fewer than words
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        ones += np.unpackbits(hashes[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column("bytes")), np.uint64, batch.num_rows)
        names = [x for x in batch.schema.names if x != "bytes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(prints.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named long columns and fp, a signed long with the fingerprint's bits, for each row."""
    schema = ", ".join(f"{c} long" for c in ("doc_id", *more, "fp"))
    return prepared(docs, *more).select("doc_id", *more, F.col("text").cast("binary").alias("bytes")).mapInArrow(_fingerprints, schema)


def blocks_for(n: int) -> int:
    return 4 if n <= 1 << 17 else 5 if n <= 1 << 27 else 6


def keys(blocks: int) -> np.ndarray:
    """Masks of the bits that a pair must share: all choices of blocks - MOST blocks."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(e)) - 1) ^ ((1 << int(s)) - 1) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return np.array([sum(c) for c in combinations(masks, blocks - MOST)], np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


DEALT = "part long, blob binary"


def _deal(masks: np.ndarray, parts_: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            at = [(_spread((fp & m) + np.uint64(k + 1)) % np.uint64(parts_)).astype(np.int64) for k, m in enumerate(masks)]
            to, which, i = np.concatenate(at), np.repeat(np.arange(len(masks)), len(fp)), np.tile(np.arange(len(fp)), len(masks))
            order = np.argsort(to, kind="stable")
            to, which, i = to[order], which[order].astype(np.uint8), i[order]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
            rows = [(int(to[s]), which[s:e].tobytes() + fp[i[s:e]].tobytes()) for s, e in zip(edge, [*edge[1:], len(to)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

    return deal


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nearer := root[root], root):
            root = nearer


class _Links:
    """Verified links of one task, reduced to a forest again and again; numbers of pairs that were met in a bucket, that the pivots left, and that are links."""

    def __init__(self, n: int):
        self.n, self.kept, self.size = n, [], 0
        self.met = self.left = self.linked = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.kept.append((a, b))
        self.size += len(a)
        if self.size > PAIRS + 2 * self.n:
            self.reduce()

    def reduce(self) -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip(*self.kept, strict=True)) if self.kept else (np.zeros(0, np.int64),) * 2
        root = _forest(self.n, a, b)
        own = np.flatnonzero(root != np.arange(self.n))
        self.kept, self.size = [(own, root[own])], len(own)
        return root


def _sweep(bucket: np.ndarray, i: np.ndarray, fp: np.ndarray, table: np.ndarray, links: _Links) -> None:
    """Links within buckets: ``i`` are fingerprints, ``bucket`` the bucket of each."""
    order = np.lexsort((table[i, 0], bucket))
    bucket, i = bucket[order], i[order]
    first = table[i, 0].astype(np.int16)
    here = np.arange(len(i) - 1)
    lag = 1
    while len(here):
        there = here + lag
        near = there < len(i)
        here, there = here[near], there[near]
        near = (bucket[here] == bucket[there]) & (first[there] - first[here] <= MOST)
        here, there = here[near], there[near]
        for at in range(0, len(here), PAIRS):
            a, b = i[here[at : at + PAIRS]], i[there[at : at + PAIRS]]
            links.met += len(a)
            for lo, hi in ((1, 4), (4, 16), (16, PIVOTS)):
                # unsigned: a difference of -3 to 3 is at most 6 after adding 3
                ok = ((table[a, lo:hi] - table[b, lo:hi] + np.uint8(MOST)) <= 2 * MOST).all(1)
                a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= MOST
            links.left += len(a)
            links.linked += int(ok.sum())
            if ok.any():
                links.add(a[ok], b[ok])
        lag += 1


def _table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances to the pivots."""
    return np.bitwise_count(fp[:, None] ^ _pivots()[None, :pivots]).astype(np.uint8)


def _search(which: np.ndarray, fp: np.ndarray, masks: np.ndarray, links: _Links, index: np.ndarray, distinct: np.ndarray) -> list[np.ndarray]:
    """All links between entries that share a bucket; ``index`` says which distinct fingerprint an entry is. Returns the crowds, which aren't searched."""
    table = _table(distinct)
    value = fp & masks[which]
    order = np.lexsort((value, which))
    which, value, index = which[order], value[order], index[order]
    lead = np.ones(len(which), bool)
    lead[1:] = (which[1:] != which[:-1]) | (value[1:] != value[:-1])
    bucket = np.cumsum(lead) - 1
    size = np.bincount(bucket)
    small = (size[bucket] > 1) & (size[bucket] <= LARGE)
    if small.any():
        _sweep(bucket[small], index[small], distinct, table, links)
    ends = np.cumsum(size)
    crowds = []
    for k in np.flatnonzero(size > LARGE):
        mine = np.arange(ends[k] - size[k], ends[k])
        if size[k] > CROWD:
            crowds.append(distinct[index[mine]])
        else:
            _divided(index[mine], ~masks[which[mine[0]]], distinct, table, links)
    return crowds


def _divided(i: np.ndarray, free: np.uint64, fp: np.ndarray, table: np.ndarray, links: _Links) -> None:
    """A large bucket: pairs share one of four blocks of the free bits, too."""
    bits = [1 << k for k in range(64) if int(free) >> k & 1]
    for k in range(MOST + 1):
        mask = np.uint64(sum(bits[k :: MOST + 1]))
        _, bucket = np.unique(fp[i] & mask, return_inverse=True)
        keep = np.bincount(bucket)[bucket] > 1
        if keep.any():
            _sweep(bucket[keep], i[keep], fp, table, links)


LINKS = "crowd long, u long, v long"


def _linked(masks: np.ndarray):
    """Links (u, v) between fingerprints, and the members u of crowds."""

    def linked(table: pa.Table) -> pa.Table:
        got = [x.as_py() for x in table.column("blob")]
        size = [len(x) // 9 for x in got]
        which = np.concatenate([np.frombuffer(x, np.uint8, n) for x, n in zip(got, size, strict=True)])
        fp = np.concatenate([np.frombuffer(x, np.uint64, n, n) for x, n in zip(got, size, strict=True)])
        distinct, index = np.unique(fp, return_inverse=True)
        links = _Links(len(distinct))
        crowds = _search(which, fp, masks, links, index, distinct)
        return _result(links, distinct, crowds, table.column("part")[0].as_py())

    return linked


def _result(links: _Links, fp: np.ndarray, crowds: list[np.ndarray], part: int) -> pa.Table:
    root = links.reduce()
    own = np.flatnonzero(root != np.arange(len(root)))
    many = [len(x) for x in crowds]
    crowd = np.repeat(part * (1 << 20) + np.arange(len(crowds)), many)
    u = np.concatenate([fp[own], *crowds]).view(np.int64)
    no = np.zeros(len(own), np.int64)
    return pa.table({"crowd": pa.array(np.concatenate([no, crowd]), pa.int64(), mask=np.arange(len(u)) < len(own)), "u": pa.array(u), "v": pa.array(np.concatenate([fp[root[own]].view(np.int64), np.zeros(sum(many), np.int64)]), pa.int64(), mask=np.arange(len(u)) >= len(own))})


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index): the cells of each fingerprint; two that no coordinate on the axes sets further apart than ``MOST`` share one."""
    place = _table(fp, AXES).astype(np.int64)
    cell, index = np.zeros(len(fp), np.int64), np.arange(len(fp))
    for k in range(AXES):
        x = place[index, k]
        more = x % CELL >= CELL - MOST  # the next cell begins MOST before its first place
        cell = np.concatenate([cell * 64 + x // CELL, (cell * 64 + x // CELL + 1)[more]])
        index = np.concatenate([index, index[more]])
    return cell, index


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("u").to_numpy().view(np.uint64)
        cell, index = cells(fp)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("crowd").to_numpy()[index]), pa.array(cell), pa.array(fp[index].view(np.int64))], names=["crowd", "cell", "u"])


def _within(table: pa.Table) -> pa.Table:
    fp = np.unique(table.column("u").to_numpy().view(np.uint64))
    links, i = _Links(len(fp)), np.arange(len(fp))
    _sweep(np.zeros(len(fp), np.int64), i, fp, _table(fp), links)
    out = _result(links, fp, [], 0)
    return out.select(["u", "v"])


def _labels(rows: DataFrame) -> DataFrame:
    """f, root (a number of its component) and component_id of each fingerprint of ``rows`` (doc_id, fp)."""
    n = parts(rows.sparkSession)
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    masks = keys(blocks_for(distinct.count()))
    dealt = distinct.select("fp").mapInArrow(_deal(masks, 4 * n), DEALT)
    found = cut(dealt.groupBy("part").applyInArrow(_linked(masks), LINKS))
    crowds = found.where("crowd is not null").mapInArrow(_to_cells, "crowd long, cell long, u long")
    links = found.where("crowd is null").select("u", "v").union(crowds.groupBy("crowd", "cell").applyInArrow(_within, "u long, v long"))
    rooted = distinct.join(components(links.distinct()), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, found)
    ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    return cut(rooted.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), rooted, distinct)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    rows = cut(fingerprints(docs))
    labels = _labels(rows)
    return rows.join(labels, rows["fp"] == labels["f"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` with all its columns for every component, of the document with the smallest doc_id; null and repeated doc_ids take part.

    With a ``similarity``, components are of texts whose sets of ``shingle`` words have at least that Jaccard similarity
    (``similar``); without, of fingerprints within ``MOST`` bits.
    """
    if similarity is not None:
        return _firsts(docs, cut(similar.near_duplicates(docs, shingle, similarity)))
    if shingle != SHINGLE:
        raise ValueError(f"fingerprints are of {SHINGLE} words; other shingles need a similarity")
    prints = cut(fingerprints(named(docs).select(F.col("id").alias("doc_id"), "text", "th"), "th"))
    labels = _labels(prints)
    return _firsts(docs, cut(prints.join(labels, prints["fp"] == labels["f"]).select(F.col("doc_id").alias("id"), "th", F.col("root").alias("component"))))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component in ``found`` (id, th, component) one row of ``docs``: of the smallest id, a null one last, then by th; of rows equal in both, any."""
    stays = cut(found.groupBy("component").agg(F.min(F.struct("id", "th")).alias("least")).select("least.id", "least.th"))
    count = found.groupBy("id", "th").agg(F.count("*").alias("n"))
    gone = cut(count.join(stays, ["id", "th"], "left_anti").select("id", "th"))
    repeated = cut(count.where("n > 1").join(stays, ["id", "th"], "left_semi").select("id", "th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", rank_of(F.col("row.doc_id").cast("long")).alias("id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("th"))
    single = rows.join(gone.union(repeated), ["id", "th"], "left_anti").select("row")
    once = rows.join(repeated, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("row").alias("row")).select("row")
    return single.union(once).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
