"""Quality classifier (operator 6): hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters and digits, or runs of other characters than these and white
space; features are hashed single words and word pairs, valued by count over the square
root of the text's number of features. Learning reads at most ``MOST_ROWS`` labelled
texts (held-out rows never); scoring is a sparse dot product of every whole text with the
one dense weight vector, whose size is fixed.

Edge cases: null or empty texts have no features and get the score of the bias; a null
doc_id counts as held out; without labels, or with labels of one kind, the score is the
smoothed share of label 1 (0.5 without any); other columns are ignored; repeated rows
each get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, sliced
from .labelled import held_out, sample

BITS, MOST_ROWS, EPOCHS = 18, 4000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Bytes of text whose words are in memory at once (or one text, if that is longer).
AT_ONCE = 2 << 20
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+")


class Model(NamedTuple):
    bias: float
    weights: np.ndarray


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and the text of each."""
    lists = [_WORD.findall(x) for x in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for x in lists for w in x]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, distinct = pd.factorize(flat)
    h = np.fromiter((zlib.crc32(w) for w in distinct), np.uint64, len(distinct))[code]
    doc = np.repeat(np.arange(len(texts)), n)
    pair = doc[1:] == doc[:-1]
    both = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[pair]
    x = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), both])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([doc, doc[1:][pair]])


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    at, size = 0, 0
    for k, x in enumerate(texts):
        if k > at and size + len(x) > AT_ONCE:
            yield texts[at:k]
            at, size = k, 0
        size += len(x)
    if texts[at:]:
        yield texts[at:]


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    out = []
    for part in grouped(texts):
        index, doc = hashed(part)
        total = np.bincount(doc, model.weights[index], len(part))
        n = np.bincount(doc, minlength=len(part))
        out.append(1 / (1 + np.exp(-np.clip(model.bias + total / np.sqrt(np.maximum(n, 1)), -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column("bytes").to_pylist():
            index, _ = hashed([x])
            rows.append(np.unique(index, return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))],
            names=["doc_id", "label", "index", "n"],
        )


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (label, features, counts), in the order given."""
    ones = sum(y for y, _, _ in rows)
    if not 0 < ones < len(rows):
        p = (ones + 1) / (len(rows) + 2)
        return Model(float(np.log(p / (1 - p))), np.zeros(1 << BITS))
    bias = float(np.log(ones / (len(rows) - ones)))  # the prior; the weights explain the rest
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for y, i, count in rows:
            i, x = np.append(i, 1 << BITS), np.append(count / np.sqrt(max(1, count.sum())), 0.1)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return Model(float(bias + 0.1 * w[-1]), w[:-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Model:
    got = sample(docs, labels, label, most).mapInArrow(_counted, "doc_id long, label int, index array<int>, n array<int>").toArrow()
    ids, y, index, n = (got.column(c).combine_chunks() for c in ("doc_id", "label", "index", "n"))
    # slices of the Arrow buffers: as Python values, the features of all rows would take ten times the memory
    edge, index, n = index.offsets.to_numpy(), index.values.to_numpy(), n.values.to_numpy()
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k].as_py()).encode()), ids[k].as_py()))
    return follow_the_leader([(int(y[k].as_py() == 1), index[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]) for k in order])


def _scored(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in sliced(batches, 4096):
            s = scores(model, batch.column("bytes").to_pylist())
            keep = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return scored


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS, with_text: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ``with_text``: text too."""
    model = train(docs, labels, label, most)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    rows = prepared(docs).select("doc_id", *["text"] * with_text, F.col("text").cast("binary").alias("bytes"))
    out = rows.mapInArrow(_scored(shared), "doc_id long, " + "text string, " * with_text + "score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["text"] * with_text)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` with all their columns that the classifier doesn't reject; one pass, no join."""
    model = train(docs, labels, label, most)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(Model(*shared.value), [x.encode("utf-8", "surrogatepass") for x in text]))

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= 0.5)
