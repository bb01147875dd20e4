"""The models against plain loops, and their quality on rows that they never learn from."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundline.llm import quality_classifier, quality_rules

MASK = (1 << 64) - 1


def plain_features(text):
    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+", text)
    h = [zlib.crc32(w) for w in words]
    raw = [x * 0xD6E8FEB86659FD93 & MASK for x in h] + [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & MASK for a, b in zip(h, h[1:], strict=False)]
    return Counter(((x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK) >> 64 - quality_classifier.BITS for x in raw)


def plain_ftrl(rows):
    q = quality_classifier
    ones = sum(y for y, _ in rows)
    prior = math.log(ones / (len(rows) - ones))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for y, counts in rows:
            size = math.sqrt(max(1, sum(counts.values())))
            x = {i: c / size for i, c in counts.items()} | {"bias": 0.1}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-(prior + sum(w[i] * x[i] for i in x))))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g

    def score(counts):
        size = math.sqrt(max(1, sum(counts.values())))
        return 1 / (1 + math.exp(-(prior + 0.1 * weight("bias") + sum(weight(i) * c / size for i, c in counts.items()))))

    return score


def test_classifier_against_a_plain_loop():
    rnd = random.Random(6)
    words = [["sun", "rain", "été", "a"], ["buy", "now!!", "$$$", "a"]]
    texts = [(k % 2, " ".join(rnd.choice(words[k % 2 if rnd.random() < 0.8 else 1 - k % 2]) for _ in range(rnd.randint(0, 30))).encode()) for k in range(50)]
    score = plain_ftrl([(y, plain_features(t)) for y, t in texts])
    rows = []
    for y, t in texts:
        index, _ = quality_classifier.hashed([t])
        index, n = np.unique(index, return_counts=True)
        rows.append((y, index, n.astype(float)))
    model = quality_classifier.follow_the_leader(rows)
    more = [t for _, t in texts] + [b"", b"sun buy", b"unseen words only"]
    assert quality_classifier.scores(model, more).tolist() == pytest.approx([score(plain_features(t)) for t in more], abs=1e-9)


def plain_boost(x, y, trees, depth):
    q = quality_rules
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, q.BINS + 1)[1:-1]).tolist())) for c in x.T]
    base = math.log(sum(y) / (len(y) - sum(y)))
    scores, models = [base] * len(y), []

    def clip(v, lo, hi):
        return min(max(v, lo), hi)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

        def grow(mine, level, lo, hi, g=g, h=h):
            total = lambda rows: (sum(g[k] for k in rows), sum(h[k] for k in rows))
            G, H = total(mine)
            if level == depth:
                return q.RATE * clip(G / (H + q.RIDGE), lo, hi)
            best, gain = None, 1e-6
            for f, places in enumerate(cuts) if len(mine) >= 2 * q.LEAST_LEAF else ():
                for c in places:
                    left, right = [k for k in mine if x[k, f] <= c], [k for k in mine if x[k, f] > c]
                    if min(len(left), len(right)) < q.LEAST_LEAF:
                        continue
                    (gl, hl), (gr, hr) = total(left), total(right)
                    vl, vr = clip(gl / (hl + q.RIDGE), lo, hi), clip(gr / (hr + q.RIDGE), lo, hi)
                    won = gl**2 / (hl + q.RIDGE) + gr**2 / (hr + q.RIDGE) - G * G / (H + q.RIDGE)
                    if q.FEATURES[f][1] * (vr - vl) >= 0 and won > gain + 1e-12:
                        best, gain = (f, c, left, right, (vl + vr) / 2), won
            if not best:
                return (0, math.inf, grow(mine, level + 1, lo, hi), None)
            f, c, left, right, mid = best
            down, up = ((lo, hi), (lo, hi)) if not q.FEATURES[f][1] else ((mid, hi), (lo, mid)) if q.FEATURES[f][1] < 0 else ((lo, mid), (mid, hi))
            return (f, c, grow(left, level + 1, *down), grow(right, level + 1, *up))

        tree = grow(list(range(len(y))), 0, -math.inf, math.inf)
        models.append(tree)

        def value(row, tree=tree):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        scores = [s + value(row) for s, row in zip(scores, x, strict=True)]
    return [1 / (1 + math.exp(-s)) for s in scores]


def test_trees_against_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.random((90, len(quality_rules.FEATURES)))
    y = (x[:, 2] + 0.4 * x[:, 8] + 0.2 * rng.random(90) < 0.8).astype(float)
    model = quality_rules.boost(x, y, trees=6, depth=2)
    assert quality_rules.predict(model, x).tolist() == pytest.approx(plain_boost(x, y.tolist(), 6, 2), abs=1e-9)


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, labels).join(labels, "doc_id").select("doc_id", "kept", "base_failed", "quality").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    bad, good = [r for r in rows if not r.quality], [r for r in rows if r.quality and not r.base_failed]
    figures = {"bad that goes": sum(not r.kept for r in bad) / len(bad), "good that stays": sum(r.kept for r in good) / len(good), "rows": len(rows)}
    print(figures)
    assert figures["bad that goes"] > 0.9 and figures["good that stays"] > 0.95, figures
