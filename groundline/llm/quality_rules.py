"""Quality rules (operator 2): fixed rules and a monotonic gradient-boosted model on document statistics.

Base rules: at least 20 words, and at most 30 % of words in 8-word windows that recur in
the text. Texts that pass are judged by gradient-boosted trees (logistic loss, histogram
splits) over statistics of the whole text. Trees are flattened into numpy arrays, in
heap order, and scored for a batch at once, one step a level. More repetition, symbols,
capitals and separators never raise the score: splits on these features that would do so
are not made, and bounds passed down the tree keep it so across levels.

Repeated windows are found exactly: words are numbered, numbers of pairs, of pairs of
pairs and of eights are built by factorising, and eights are counted within the text.

Edge cases: null or empty texts have no words, so base_failed; without labels, or with
labels of one kind, the model keeps whatever passes the base rules; other columns are
ignored; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, sliced
from .labelled import sample
from .quality_classifier import grouped

WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
MOST_ROWS, TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 6000, 60, 3, 0.15, 32, 15, 1.0
#: Statistics the trees see, with the direction in which each may move the score (0: either).
FEATURES = (("log_words", 0), ("word_length", 0), ("symbol_share", -1), ("repeat_share", -1), ("dup_line_share", -1), ("capital_share", -1), ("mark_share", -1), ("digit_share", 0), ("distinct_share", 0), ("line_words", 0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"  # fixed values
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, *range(9, 14)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[ord("A") : ord("Z") + 1] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?=_~^+@/\\|")] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[ord("0") : ord("9") + 1] = True


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers: equal exactly if the pairs are."""
    return pd.factorize(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right)[0]


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (long) and FEATURES (double), a row for each text."""
    n_docs = len(texts)
    lists = [x.split() for x in texts]
    n = np.fromiter(map(len, lists), np.int64, n_docs)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for x in lists for w in x]
    doc = np.repeat(np.arange(n_docs), n)
    repeated, distinct = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    if len(flat):
        code = pd.factorize(flat)[0].astype(np.int64)
        seen = np.unique(doc * (int(code.max()) + 1) + code)
        distinct = np.bincount(seen // (int(code.max()) + 1), minlength=n_docs)
        k = 1
        while k < WINDOW and len(code) > k:
            code = _paired(code[:-k], code[k:])
            k *= 2
        windows = len(flat) - WINDOW + 1
        if windows > 0:
            code = code[:windows]
            inside = doc[:windows] == doc[WINDOW - 1 :]
            own = _paired(doc[:windows][inside], code[inside])
            again = np.flatnonzero(inside)[np.bincount(own)[own] > 1]
            cover = np.zeros(len(flat) + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)
    size = np.fromiter(map(len, texts), np.int64, n_docs)
    data = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(n_docs), size)
    count = lambda mask: np.bincount(of[mask], minlength=n_docs)
    chars = count(((data & 0xC0) != 0x80) & ~_IS_WS[data])
    symbols, capitals, marks, digits = (count(t[data]) for t in (_IS_SYMBOL, _IS_CAPITAL, _IS_MARK, _IS_DIGIT))
    lines, dup = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for k, x in enumerate(texts):
        if b"\n" in x:
            full = [y for y in x.split(b"\n") if y and not y.isspace()]
            lines[k], dup[k] = len(full), len(full) - len(set(full))
        else:
            lines[k] = bool(n[k])
    share = lambda a, b: a / np.maximum(b, 1)
    features = np.column_stack([np.log1p(n), share(chars, n), share(symbols, chars), share(repeated, n), share(dup, lines), share(capitals, chars), share(marks, chars), share(digits, chars), share(distinct, n), share(n, lines)])
    return np.column_stack([n, chars, symbols, dup, repeated]).astype(np.int64), features


class Trees(NamedTuple):
    """Flattened trees, heap order: children of node k are 2k + 1 and 2k + 2; inner nodes have a feature and a threshold, the last level values."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of features."""
    total = np.full(len(x), model.base)
    rows = np.arange(len(x))
    inner = model.feature.shape[1]
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        total += value[node - inner]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Gradient boosting with the monotonic directions of FEATURES."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return Trees(35.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    direction = [d for _, d in FEATURES]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    base = float(np.log(ones / (len(y) - ones)))
    score = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            lo, hi = bounds[k]
            best = _best_split(binned[mine], g[mine], h[mine], cuts, direction, lo, hi)
            right = np.zeros(len(mine), bool)
            bounds[2 * k + 1] = bounds[2 * k + 2] = (lo, hi)
            if best:
                f, b, left_value, right_value = best
                out.feature[t, k], out.threshold[t, k] = f, cuts[f][b]
                right = binned[mine, f] > b
                if direction[f]:
                    mid = (left_value + right_value) / 2
                    low, high = (lo, mid), (mid, hi)
                    bounds[2 * k + 1], bounds[2 * k + 2] = (high, low) if direction[f] < 0 else (low, high)
            node[mine] = 2 * k + 1 + right
        for leaf in range(leaves):
            mine = node == inner + leaf
            lo, hi = bounds[inner + leaf]
            out.value[t, leaf] = RATE * np.clip(g[mine].sum() / (h[mine].sum() + RIDGE), lo, hi)
        score += out.value[t][node - inner]
    return out


def _best_split(binned, g, h, cuts, direction, lo, hi):
    best, gain = None, 1e-6
    if len(g) < 2 * LEAST_LEAF:
        return None
    G, H = g.sum(), h.sum()
    whole = G * G / (H + RIDGE)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        size = len(c) + 1
        n = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        gl, hl = np.cumsum(np.bincount(binned[:, f], g, size))[:-1], np.cumsum(np.bincount(binned[:, f], h, size))[:-1]
        left, right = np.clip(gl / (hl + RIDGE), lo, hi), np.clip((G - gl) / (H - hl + RIDGE), lo, hi)
        won = gl**2 / (hl + RIDGE) + (G - gl) ** 2 / (H - hl + RIDGE) - whole
        won[(n < LEAST_LEAF) | (len(g) - n < LEAST_LEAF) | (direction[f] * (right - left) < 0)] = 0
        b = int(won.argmax())
        if won[b] > gain:
            best, gain = (f, b, left[b], right[b]), won[b]
    return best


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics([x])[1][0] for x in batch.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Trees:
    got = sample(docs, labels, "quality", most).mapInArrow(_measured, "doc_id long, label int, x array<double>").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "label", "x")), strict=True))
    return boost(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r[1] == 1) for r in rows]))


RESULT = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, score double"


def _judged(shared, least: float):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shared.value)
        for batch in sliced(batches, 4096):
            at = 0
            for texts in grouped(batch.column("bytes").to_pylist()):
                counts, x = statistics(texts)
                score = predict(model, x)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
                cols = [batch.column("doc_id").slice(at, len(texts)), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return judged


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = MOST_ROWS) -> DataFrame:
    """The statistics, base_failed, the trees' score and kept for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(train(docs, labels, most)))
    return prepared(docs).select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(_judged(shared, least), RESULT)
