"""Each operator against brute force, over odd rows: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundline.llm import components, exact_dedup, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, rolling, similar, simhash, substring_dedup, suffix_dedup
from groundline.llm.exchange import dealt_by_text, distinct_keys
from groundline.llm.suffix_index import LogIndex, suffix_order

CLASHING = {c: "x" for c in ("id", "th", "a", "b", "pos", "chunk", "bucket", "blob", "bytes", "fp", "rep", "row", "group", "size", "key", "dropped", "first", "score", "label", "n", "cell", "s", "head", "hash", "salt", "text_sha256", "times", "copy", "u", "v", "removed")}
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
PASSAGE = "This passage of quite some length recurs in several documents, word for word, and has to go. It has a second sentence of many words too."


def odd_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [prose(rnd.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, f"{prose(8)} {PASSAGE}\nSHARED line {'' if i % 2 else '  '}\n{prose(9)}", "s0") for i in range(12)]
    rows += [(200, None, None), (201, "", "s1"), (202, "", None), (203, " \n\t\n", "s1"), (None, texts[3], "s2"), (None, None, None), (None, PASSAGE, "s2")]
    rows += [(300, texts[5], "s3"), (300, texts[5], "s3"), (301, texts[5], "s3"), (302, texts[5] + " x", "s3"), (303, texts[7], None), (304, "a" * 3000, "s0"), (305, "a" * 3100 + "\n" * 50, "s0")]
    rows += [(400, " ".join(word() for _ in range(20000)), "s1"), (401, "é" * 80 + "日本語" * 40, "s1"), (402, "日本語" * 40 + "é" * 80, "s2"), (403, "ab " * 2000, "s2")]
    rows += [(300, "another text under a used number", "s3"), ((1 << 62) + 5, "one text under a very large number", "s1"), (-7, "one text under a negative number, and no other", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, *CLASHING.values()) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(i):
    return (1 << 63) - 1 if i is None else i


# --- suffix arrays


def suffix_brute(rows, width=50):
    seen = {}
    for i, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            seen.setdefault(b[p : p + width], order(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < order(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), sha(kept)))
    return out


def test_suffix_dedup(docs, rows):
    got = [tuple(r) for r in suffix_dedup.dedup_digests(docs).collect()]
    assert Counter(got) == Counter(suffix_brute(rows))
    assert any(r[2] for r in got)


def test_suffix_spans(docs):
    digests = {(r.doc_id, r.n_bytes, r.kept_sha256): r for r in suffix_dedup.dedup_digests(docs).collect()}
    for r in suffix_dedup.dedup_spans(docs).collect():
        removed = sum(e - s for s, e in zip(r.starts, r.ends, strict=True))
        d = digests[r.doc_id, len(r.text_bytes) + removed, sha(bytes(r.text_bytes))]
        assert (removed, len(r.starts)) == (d.n_removed, d.n_spans)


def test_suffix_dedup_of_a_new_batch(spark, rows):
    schema = "doc_id long, text string"
    old, new = [(i, t) for i, t, _ in rows if (i or 0) % 2], [(i, t) for i, t, _ in rows if not (i or 0) % 2]
    got = Counter(tuple(r) for r in suffix_dedup.dedup_digests(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect())
    ranked = [(-1, t) for _, t in old] + new
    assert got == Counter(r for r in suffix_brute(ranked) if r[0] != -1)


def test_suffix_dedup_deals_equal_texts_together(spark, monkeypatch):
    rnd = random.Random(31)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = text(120)
    rows = [(20 * k + c, x) for k, x in enumerate([text(150) + shared + text(100) for _ in range(30)]) for c in range(3)]
    rows += [(5000 + c, shared * 3) for c in range(60)] + [(6000, None), (6000, ""), (None, rows[0][1]), (7, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    at = defaultdict(set)
    for r in dealt_by_text(docs, 8000).collect():
        at[bytes(r.bytes).decode()].add(r.chunk)
    assert 2 <= len(at.pop(shared * 3)) <= 15  # 21,600 bytes of copies, in shares of 2,000
    assert len(set().union(*at.values())) > 3 and all(len(x) == 1 for x in at.values())
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 8000)
    assert Counter(tuple(r) for r in suffix_dedup.dedup_digests(docs).collect()) == Counter(suffix_brute(rows))


def test_suffix_chunks_send_text_and_little_else_and_keep_no_tables():
    import pyarrow as pa

    data = np.random.default_rng(3).integers(32, 127, 200_000).astype(np.uint8).tobytes().decode()
    chunk = pa.table({"doc_id": [1], "chunk": [0], "bytes": [data.encode()]})
    c = suffix_dedup.Chunk(chunk)
    key, _ = distinct_keys(c.key, c.owner)
    often = pa.table({"bucket": [0], "chunk": [0], "blob": [np.packbits(np.concatenate([np.ones(len(key), bool), np.zeros(len(key), bool)])).tobytes()]})
    sent = suffix_dedup._send_runs(1)(chunk, often)
    # zstd makes 0.64 of such runs; 16 bytes of hashes for each would make it 0.88
    assert len(sent["blob"][0].as_py()) < 0.7 * (c.count + 49).sum()
    kept = [x for v in vars(rolling).values() for x in (v.values() if isinstance(v, dict) else [v])]
    assert sum(y.nbytes for x in kept for y in (x if isinstance(x, tuple) else [x]) if isinstance(y, np.ndarray)) < 1 << 16


def test_suffix_dedup_with_divided_anchors(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [rnd.choice([b"", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]) + b"".join(rnd.choice([b"the same phrase of words", b"xy", b"a phrase in other words, and more", bytes([rnd.randrange(97, 103)])]) for _ in range(80)) for _ in range(40)]
    table = pa.table({"doc_id": pa.array(range(40)), "bytes": pa.array(texts, pa.binary())})
    whole, parts = suffix_dedup.Chunk(table), suffix_dedup.Chunk(table)
    hot = whole.key % np.uint64(3) > 0
    parts.divide(hot)
    covered = lambda c: np.sort(np.concatenate([np.arange(s, s + n) for s, n in zip(c.start, c.count, strict=True)]))
    assert np.array_equal(covered(whole), covered(parts)) and len(parts.start) > len(whole.start)
    deals = defaultdict(set)  # equal windows go to one bucket
    for s, n, d in zip(parts.start.tolist(), parts.count.tolist(), parts.deal.tolist(), strict=True):
        for w in range(s, s + n):
            deals[parts.data[w : w + 50].tobytes()].add(d)
    assert all(len(d) == 1 for d in deals.values())
    # the whole operator with every anchor hot
    monkeypatch.setattr(suffix_dedup, "recurring", lambda key, buckets, right: (np.ones(len(key), bool),) * 2)
    keys = pa.table({"bucket": [0], "chunk": [0], "blob": [b""]})
    one = table.append_column("chunk", pa.array([0] * 40))
    found = suffix_dedup._least_owners(suffix_dedup._send_runs(1)(one, keys))
    got = Counter(tuple(r.values()) for r in suffix_dedup._finish(1, suffix_dedup._digests)(one, found).to_pylist())
    assert got == Counter(suffix_brute([(i, t.decode()) for i, t in enumerate(texts)]))


def test_suffix_kernels_are_bounded_on_constant_texts():
    import tracemalloc

    import pyarrow as pa

    def chunk(k, i):
        return pa.table({"doc_id": pa.array([i]), "bytes": pa.array([b"a" * 5_000_000], pa.binary()), "chunk": pa.array([k])})

    tracemalloc.start()
    keys = pa.concat_tables(suffix_dedup.send_keys(suffix_dedup._keys_of, 1)(chunk(k, i)) for k, i in ((0, 1), (1, 2)))
    often = suffix_dedup.common(keys)
    sent = [suffix_dedup._send_runs(1)(chunk(k, k + 1), often.slice(k, 1)) for k in (0, 1)]
    found = suffix_dedup._least_owners(pa.concat_tables(sent))
    out = [suffix_dedup._finish(1, suffix_dedup._digests)(chunk(k, k + 1), found.filter(pa.compute.equal(found["chunk"], k))).to_pylist()[0] for k in (0, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["n_removed"] for r in out] == [0, 5_000_000] and peak < 500 << 20, peak >> 20


def test_log_index():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (3000, 8)).astype(np.uint8)
    owners = np.sort(rng.integers(0, 500, 3000))
    index, seen = LogIndex(8, batch=64), {}
    got = np.concatenate([index.add(rows[a : a + 700], owners[a : a + 700]) for a in range(0, 3000, 700)])
    for r, o, g in zip(rows, owners, got, strict=True):
        assert seen.setdefault(bytes(r), o) == g
    sizes = [len(keys) for keys, _ in index.levels]
    assert len(sizes) <= 12 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))  # noqa: B905
    assert [bytes(r) for r in rows[suffix_order(rows)]] == sorted(bytes(r) for r in rows)


# --- quality rules


def rules_brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


@pytest.fixture(scope="module")
def labels(spark, rows):
    known = sorted({r[0] for r in rows if r[0] is not None})
    return spark.createDataFrame([(i, int(i < 100), None, "x") for i in known] + [(None, 1, 0, "y"), (5, None, 0, "y"), (999, 0, 1, "z")], "doc_id long, quality int, toxic int, text string")


def test_quality_rules(docs, rows, labels):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs, labels).collect())
    assert got == Counter((i, *rules_brute(t)) for i, t, _ in rows)


def test_rules_without_labels_keep_what_passes(docs, labels):
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, labels.limit(0)).collect())


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality_rules.FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 0] + 0.2 * rng.random(800) < 0.7).astype(float)
    model = quality_rules.boost(x, y)
    assert ((quality_rules.predict(model, x) >= 0.5) == (y == 1)).mean() > 0.93
    for f, (_, d) in enumerate(quality_rules.FEATURES):
        if d:
            lifted = np.repeat(x[:20], 50, 0)
            lifted[:, f] = np.tile(np.linspace(0, 1, 50), 20)
            steps = np.diff(quality_rules.predict(model, lifted).reshape(20, 50), axis=1)
            assert (steps * d >= -1e-12).all()


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def pii_brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits(m)[::-1])) % 10 == 0]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_against_plain_patterns():
    rnd = random.Random(2)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "+1 (", "555", "-", " ", "9", "44", "+", "x", "_", "%", "4111 1111 1111 1111", "é", ")", "0"]
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == pii_brute(t)


def test_base_spans_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "1.." * 70_000, "@" * 200_000, "0" * 5000 + "1." * 3 + "1" * 5000):
        assert pii.base_spans(t) == []
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]


def test_stretches_of_any_length_are_decoded_in_blocks(monkeypatch):
    texts = [" ".join(t for t, _ in random.Random(k).sample(unseen_forms(7, 10), 60)) for k in range(6)] + ["a1 " * 30_000]
    got = pii.find(texts)
    assert sum(len(a) for _, a in got) > 100
    monkeypatch.setattr(pii, "BLOCK", 1 << 30)
    assert pii.find(texts) == got


def unseen_forms(seed, n):
    """Texts with one made-up span each, of forms and words that aren't in the labelled table, and texts with none."""
    rnd = random.Random(seed)
    pick = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    name = lambda: pick(low, rnd.randint(3, 8))
    prose = lambda: rnd.choice(["a cold wind came down from those hills", "each of them had brought some bread", "you could hear bells all morning", "by 1874 only 16 ships were left", "dated 3/11/1999 and sent by 18:45"])
    forms = {
        "secret": [lambda: ('token = "', pick(hexa, 40), '"'), lambda: ("api_key = ", "sk_test_" + pick(low + up + dig, 20), ""), lambda: ("password: ", pick(up, 1) + pick(low, 6) + pick(up, 1) + pick(low, 7), ""), lambda: ("secret = ", pick(low + up + dig, 24), ""), lambda: ("set key=", pick(up + dig, 20), "")],
        "email": [lambda: ("mail ", f"{name()} [at] {name()} [dot] {rnd.choice(['org', 'net', 'de'])}", ""), lambda: ("ask ", f"{name()}.{name()} (at) {name()} (dot) com", "")],
        "phone": [lambda: ("call ", f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", ""), lambda: ("phone ", f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}", ""), lambda: ("tel. ", f"0{pick(dig, 2)} / {pick(dig, 6)}", "")],
        "ip": [lambda: ("host ", f"2001:db8:{pick(hexa, 4)}:{pick(hexa, 3)}:{pick(dig, 4)}:{pick(hexa, 4)}:{pick(dig, 3)}:{pick(dig, 4)}", "")],
    }
    out = []
    for kind, makers in forms.items():
        for make in makers * n:
            before, x, after = make()
            t = f"{prose()} {before}"
            out.append((f"{t}{x}{after} {prose()}", (len(t), len(t) + len(x), kind)))
    plain = ["on page {} of chapter {} it says so", "version {}.{} came out in {}", "in {} there were {} of them", "the {} items cost ${}.{}", "see vol. {}, no. {}, pp. {}-{}", "room {} at {} pm", "the password: it was never written down", "the key: a good deal of patience", "one dot near line {}"]
    return out + [(f"{prose()} {rnd.choice(plain).format(*[rnd.randint(1, 2030) for _ in range(4)])} {prose()}", None) for _ in range(10 * n)]


def test_crf_on_unseen_forms():
    rows = unseen_forms(41, 40)
    found = [a for _, a in pii.find([t for t, _ in rows])]
    whole = sum(want in a for (_, want), a in zip(rows, found, strict=True) if want)
    touched = sum(any(s < want[1] and want[0] < e for s, e, _ in a) for (_, want), a in zip(rows, found, strict=True) if want)
    right = sum(bool(want) and s < want[1] and want[0] < e for (_, want), a in zip(rows, found, strict=True) for s, e, _ in a)
    n = sum(want is not None for _, want in rows)
    figures = {"whole": whole / n, "touched": touched / n, "precision": right / sum(map(len, found))}
    print(figures)
    assert figures["whole"] > 0.9 and figures["touched"] > 0.95 and figures["precision"] > 0.95, figures


def test_crf_adds_secrets_and_leaves_prose():
    texts = ['it has token = "7a61bd05c2f94e83a6d0175e8b3c9f2204de81ab" in it', "In 1998 about 25 people met on page 17.", "mail a.b@c.org now", None or ""]
    got = pii.find(texts)
    assert [k for _, _, k in got[0][1]] == ["secret"] and not got[1][1] and got[2][0][0][2] == "email" and got[3] == ([], [])
    s, e, _ = got[0][1][0]
    assert texts[0][s:e] == "7a61bd05c2f94e83a6d0175e8b3c9f2204de81ab"


def test_crf_finds_spans_without_digits():
    for t, span in (
        ("mail jane [at] example [dot] org about it", "jane [at] example [dot] org"), ("ask li.wei (at) mail (dot) example (dot) com", "li.wei (at) mail (dot) example (dot) com"),
        ("write to tom.smith [at] company [dot] net now", "tom.smith [at] company [dot] net"), ("set password = correct-Horse-Battery in it", "correct-Horse-Battery"), ("secret: MyVeryHiddenPhrase ok", "MyVeryHiddenPhrase"),
    ):
        assert [t[s:e] for s, e, _ in pii.find([t])[0][1]] == [span]
    for t in ("the password: it is a word of God", "a key: the first of many", "a word like dieeneinchkeit stands near 1998 alone"):
        assert not pii.find([t])[0][1]


def test_segments_end_with_words():
    long_one = "x7" + "aB" * 60
    t = f"secret: {long_one} end"
    assert [t[s:e] for s, e, _ in pii.find([t])[0][1]] == [long_one]
    for t in (f"{'wordy ' * 30}{'a' * 90}5{'b' * 90} {'wordy ' * 30}", "a" * 500 + "1", "1" + "a" * 500, "1 " + "ab " * 100 + "c" * 100 + "2"):
        spans = list(pii._segments(t))
        assert all((s == 0 or t[s - 1] == " ") and (e == len(t) or t[e] == " ") for s, e in spans)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    n = len(pii.LABELS)
    w, t = rng.normal(size=(50, n)), rng.normal(size=(n, n)) + pii._allowed()
    seqs = [rng.integers(1, 50, (k, pii.WIDTH_OF_TOKEN)) for k in (1, 3, 2)]
    start = np.array([-1e9 if x[0] == "I" else 0.0 for x in pii.LABELS])
    for x, y in zip(seqs, pii.viterbi(seqs, (w, t)), strict=True):
        e = w[x].sum(1)
        best = max(np.ndindex(*[n] * len(x)), key=lambda p, e=e: start[p[0]] + sum(e[k, p[k]] for k in range(len(p))) + sum(t[p[k], p[k + 1]] for k in range(len(p) - 1)))
        assert tuple(y) == best


def test_find_spans(docs, rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_spans(docs).collect())
    want = Counter()
    for i, t, _ in rows:
        b = pii_brute(t or "")
        want[(i, *(sum(k == x for _, _, x in b) for k in pii.KINDS), sha(",".join(f"{k}:{s}:{e}" for s, e, k in b)))] += 1
    assert got == want


# --- mixing


def test_targets_by_repeated_sharing(spark):
    rnd = random.Random(3)
    for _ in range(3):
        sizes = {f"s{k:02}": rnd.choice([0, 1, 5, 100, 5000, 100000]) for k in range(rnd.randint(1, 9))} | {None: 7}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        want, free, left = {}, set(names), float(sum(sizes.values()))
        while free:
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
            if not over:
                want |= {s: left * weight[s] / total for s in free}
                break
            for s in over:
                want[s] = 3.0 * sizes[s]
            left -= sum(want[s] for s in over)
            free -= set(over)
        assert got == pytest.approx(want)


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.times * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixed_is_what_the_mix_takes(spark, docs, rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    many = [(None, None, "a", 1)] * 30 + [(7, "one two three four", "b", k % 2) for k in range(2500)] + [(k, "five words are in this", "c", 0) for k in range(400)] + [(None, f"text {k} of none", "d", 0) for k in range(200)]
    for df, of in ((docs, rows), (spark.createDataFrame(many, "doc_id long, text string, source string, n_chars int").repartition(5), many)):
        taken = Counter()
        for r in mixing.mix(df).collect():
            taken[r.doc_id, r.source] += r.taken
        got, copies = Counter(), Counter()
        for r in mixing.mixed(df).collect():
            got[r.doc_id, r.source] += words(r.text)
            copies[r.doc_id, r.text, r.source, r.n_chars] += 1
        assert got == Counter({k: n for k, n in taken.items() if n})
        assert all(n <= 3 * sum(x[:3] == k[:3] for x in of) for k, n in copies.items())


def test_equal_rows_and_rows_without_id_are_spread(spark):
    df = spark.createDataFrame([(7, "one two three four", "b")] * 3000 + [(None, f"x y z {k}", "b") for k in range(3000)], "doc_id long, text string, source string")
    places = sorted(r.place for r in mixing._dealt(mixing._equal_rows(df)).collect())
    assert len(set(places)) == 6000
    cells = Counter(int(p * 20) for p in places)
    assert max(cells.values()) < 1000


# --- near duplicates


def print_brute(t):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    prints = [print_brute(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), order(None)), order(i))
    # a null doc_id and an id that has another text elsewhere link as the ids do
    want = Counter((i, prints[k], None if least[find(k)] == order(None) else least[find(k)]) for k, (i, *_) in enumerate(rows))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def five_word_components(rows, similarity=0.8):
    words = [(t or "").encode().lower().split() for _, t, *_ in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def test_near_copies_of_five_word_shingles(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8)))
    rows, far = [], 0
    for g in range(40):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for c in range(2 if g else 30):  # a crowd, larger than a bucket that is compared pair by pair
            copy = list(base)
            for _ in range(rnd.randint(0, 3) if c else 0):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, ""), (1001, None), (1002, "two words"), (1003, "Two  words")]
    label = five_word_components(rows)
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    far = sum((prints[k] ^ prints[r]).bit_count() > 3 for k, r in enumerate(label))
    assert far > 5  # near copies that the operator's fingerprints leave
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=5, similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == [rows[k][0] for k, r in enumerate(label) if k == r]


def crowd_of_sets(rng, n=300):
    """A bucket's table: sets about two bases that share from a third to nearly all of their shingles, each its own component."""
    import pyarrow as pa

    bases = rng.integers(0, 1 << 63, (2, 120), dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(bases[k % 2], 120 - m, replace=False), rng.integers(0, 1 << 63, m, dtype=np.uint64)])) for k, m in enumerate(rng.integers(3, 50, n))]
    ids = np.arange(n, dtype=np.int64) * 7
    return sets, pa.table({"bucket": np.zeros(n, np.int64), "u": ids, "n": np.array([len(x) for x in sets], np.int32), "sketch": [similar.fingerprint(x).tobytes() for x in sets], "root": ids, "hashes": [x.tobytes() for x in sets]})


def test_crowds_give_a_forest_of_all_their_links():
    sets, table = crowd_of_sets(np.random.default_rng(5))
    root = list(range(len(sets)))
    want = simhash._forest(len(sets), *np.array([(a, b) for a in range(len(sets)) for b in range(a) if len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))]).T)
    links = similar._linked(0.8)(similar._meeting(0.8)(table))
    assert 30 < links.num_rows < len(root)  # of a forest, not of all pairs
    got = simhash._forest(len(sets), links["u"].to_numpy() // 7, links["v"].to_numpy() // 7)
    assert (got == want).all()
    one = table.set_column(4, "root", [np.zeros(len(sets), np.int64)])
    assert not similar._meeting(0.8)(one).num_rows  # a component's own pairs aren't searched


def test_pivot_tables_discard_only_pairs_beyond_the_radius():
    sets, table = crowd_of_sets(np.random.default_rng(6))
    entry, root = similar._members(table)
    most = similar.radius(0.8)
    found = {frozenset((k, j)) for k, other in similar.searched(entry, root, 0.8) for j in other.tolist()}
    away = lambda a, b: int(np.bitwise_count(entry["sketch"][a] ^ entry["sketch"][b]).sum())
    sized = lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
    assert found == {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if away(a, b) <= most and sized(a, b)}
    pivots = similar.pivot_table(entry, most).astype(int)
    discarded = [(a, b) for a in range(len(sets)) for b in range(a) if abs(pivots[a] - pivots[b]).max() > most]
    assert len(discarded) > 100 and all(away(a, b) > most for a, b in discarded)


def test_radius_of_wide_fingerprints():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    ones = [[int((((int(x) ^ int(s)) * int(o)) % (1 << 64)) ^ (((int(x) ^ int(s)) * int(o)) % (1 << 64)) >> 33) * 0xFF51AFD7ED558CCD % (1 << 64) for s, o in similar._SIGNS.T] for x in h]
    bits = [sum((w[k // 64] ^ w[k // 64] >> 33) >> k % 64 & 1 for w in ones) * 2 > len(h) for k in range(256)]
    assert np.unpackbits(similar.fingerprint(h).view(np.uint8), bitorder="little").tolist() == bits
    for c, x, y in ((4, 0, 1), (8, 1, 1), (40, 5, 5), (200, 25, 25)):  # 0.8 of the union
        base, more = rng.integers(0, 1 << 63, (500, c), dtype=np.uint64), rng.integers(0, 1 << 63, (500, x + y), dtype=np.uint64)
        d = [np.bitwise_count(similar.fingerprint(np.append(b, m[:x])) ^ similar.fingerprint(np.append(b, m[x:]))).sum() for b, m in zip(base, more, strict=True)]
        assert max(d) <= similar.radius(0.8) < 128 and np.mean(d) == pytest.approx(256 * similar._differing(c, x, y), rel=0.03)


@pytest.mark.parametrize("by", [{}, {"shingle": 5, "similarity": 0.8}])
def test_one_row_of_each_component_stays(spark, by):
    rnd = random.Random(19)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8))) for _ in range(50))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (None, a), (1, b), (3, b), (None, c), (None, c), (None, d), (4, e), (4, c), (5, a)]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **by).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (1, b), (4, c), (None, d), (4, e)])


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_search_finds_every_link(blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base[rng.integers(0, 200, 1500)].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    crowd = base[0] ^ (np.uint64(1) << rng.integers(0, 12, (1200, 5)).astype(np.uint64)).sum(1).astype(np.uint64)  # a large bucket
    fp = np.unique(np.concatenate([base, near, crowd]))
    masks, links = simhash.keys(blocks), simhash._Links(len(fp))
    which, index = np.repeat(np.arange(len(masks)), len(fp)), np.tile(np.arange(len(fp)), len(masks))
    simhash._search(which, fp[index], masks, links, index, fp)
    got = links.reduce()
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert np.array_equal(got, simhash._forest(len(fp), a, b))


def test_pivots_discard_most_pairs():
    rng = np.random.default_rng(8)
    fp = np.unique(rng.integers(0, 1 << 16, 3000, dtype=np.uint64) << np.uint64(40))  # one bucket of bits far apart
    links = simhash._Links(len(fp))
    simhash._sweep(np.zeros(len(fp), np.int64), np.arange(len(fp)), fp, simhash._table(fp), links)
    assert links.linked <= links.left < links.met / 10


def test_crowds_are_dealt_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    flips = rng.integers(0, 24, (900, 4))
    fp = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << flips.astype(np.uint64)).sum(1).astype(np.uint64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    cell, index = simhash.cells(fp)
    shared = np.zeros_like(near)
    for c in np.unique(cell):
        i = index[cell == c]
        shared[np.ix_(i, i)] = True
    assert shared[near].all() and len(np.unique(cell)) > 20
    monkeypatch.setattr(simhash, "CROWD", 600)  # seen by the kernels, which are pickled by reference: so they are called here
    masks, links = simhash.keys(4), simhash._Links(len(fp))
    crowds = simhash._search(np.full(len(fp), 3, np.uint8), fp, masks, links, np.arange(len(fp)), fp)
    assert sum(map(len, crowds)) == len(fp) and not links.kept
    import pyarrow as pa

    out = simhash._result(links, fp, crowds, 3)
    batch = next(simhash._to_cells(iter(out.select(["crowd", "u"]).to_batches())))
    links = []
    for c in pa.compute.unique(batch.column("cell")).to_pylist():
        found = simhash._within(pa.table(batch).filter(pa.compute.equal(batch.column("cell"), c)))
        links += zip(found["u"].to_numpy().view(np.uint64).tolist(), found["v"].to_numpy().view(np.uint64).tolist(), strict=True)
    place = {int(x): k for k, x in enumerate(fp)}
    got = simhash._forest(len(fp), *(np.array([place[x[k]] for x in links], np.int64) for k in (0, 1)))
    assert np.array_equal(got, simhash._forest(len(fp), *np.nonzero(near)))


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert got == {x: find(x) for x in root if find(x) != x}


# --- quality classifier


def test_classifier(docs, rows, labels):
    got = quality_classifier.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_classifier_ignores_held_out_labels(docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs, flipped)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_classifier_learns_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.classify(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


# --- packing


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {}
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids_of.setdefault(i, []).append(ids)
        want[i] += len(ids)
    got = packing.pack(docs).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids_of[r.doc_id])
    assert total == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(want.values()) / (2048 * len(windows)) > 0.9


def test_fast_ids_are_the_tokenizers():
    enc = packing.Encoder(*packing.paths())
    rnd = random.Random(0)
    pieces = ["Hello", " ", "  ", "\n", "\t", "ß", "é", "don't", "'s", "123", "  x", "\x0b", "\x1c", "\x85", "\xa0", "“q”", "$$$", "!!", "<|endoftext|>", "日本", "ñandú", "\r\n", " ", "’ll"]
    for _ in range(1500):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert enc(t).tolist() == enc.full.encode(t, add_special_tokens=False).ids, repr(t)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 600)
    items, sums = packing.differenced(sizes, 40)
    assert sorted(k for x in items for k in x) == list(range(600))
    assert [int(sizes[x].sum()) for x in items] == sums.tolist() and sums.max() - sums.min() < 60


# --- exact, line and substring dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, rows, keep):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t, _ in rows:
        g = groups[t or ""]
        real = [x for x in g if x is not None]
        best = (min if keep == "smallest" else max)(real) if real else None
        want[(i, best, len(g), i == best, sha(t or ""))] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, keep).collect()) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort_makes_one_run_of_each_text(docs, rows, keep):
    runs = exact_dedup.sorted_runs(docs, keep).collect()
    cold = Counter(r.text_sha256 for r in runs if r.lead and not r.hot)
    assert set(cold.values()) == {1} and all(r.text is None for r in runs if not (r.hot and r.lead))
    assert len(cold) + len({r.text_sha256 for r in runs if r.hot}) == len({t or "" for _, t, *_ in rows})


def test_content_sort_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert exact_dedup.sorted_runs(docs).where("lead").count() == docs.select("text").distinct().count() == 927


def test_hot_texts_make_many_runs(spark):
    df = spark.createDataFrame([(k, "hot") for k in range(400)] + [(k, str(k)) for k in range(400, 800)] + [(None, "hot")], "doc_id long, text string")
    runs = [r for r in exact_dedup.sorted_runs(df).collect() if r.hot and r.lead]
    assert {r.text for r in runs} == {"hot"} and 5 <= len(runs) <= 10 and max(r.n for r in runs) < 110 and sum(r.n for r in runs) == 401
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, "largest").where("group_size > 1").collect()} == {(399, 401)}


def lines_brute(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add((i, t))
    gone = {k for k, d in docs.items() if k and len(d) >= least}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        yield i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)


def test_line_dedup(docs, rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in line_dedup.dedup_lines(docs).collect())
    assert got == Counter(x[:4] for x in lines_brute(rows))
    assert sum(n * c for (_, _, n, _), c in got.items()) == 12


def test_line_bitmaps_rebuild_the_text(docs, rows):
    for r in line_dedup.line_bitmaps(docs).collect():
        lines = r.text.split("\n")
        kept = [x for run in r.bitmap for x in lines[run["first"] : run["first"] + run["n"]]]
        assert len(kept) == r.n_lines - r.n_dropped


def test_first_lines_can_stay(spark):
    rows = [(3, "a\nb\na"), (1, "x\n A \nb"), (2, "c\nB"), (None, "a")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, keep_first=True).collect()}
    assert got == {1: "x\n A \nb", 2: "c", 3: "", None: ""}


def test_cleaned_keeps_all_columns(docs, rows):
    out = line_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, sha(r.text or "")) for r in out.collect()) == Counter((i, s) for i, _, _, s, _ in lines_brute(rows))


def substring_brute(rows, least=substring_dedup.MIN_WORDS, width=51):
    """Removed spans and kept text of each row, by dictionaries of whole units."""
    read = []
    for i, t, *_ in rows:
        t = t or ""
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        words = [t[s:e].translate({c: c + 32 for c in range(65, 91)}) for s, e in places]
        ends = [k for k, (_, e) in enumerate(places) if k + 1 == len(places) or t[e - 1] in ".!?" or "\n" in t[e : places[k + 1][0]]]
        sentences = [(s, e + 1) for s, e in zip([0] + [k + 1 for k in ends], ends)]
        read.append((order(i), t, places, words, sentences))
    first = {}
    for i, _, _, words, sentences in read:
        for s, e in [x for x in sentences if x[1] - x[0] >= least]:
            first["s", *words[s:e]] = min(i, first.get(("s", *words[s:e]), i))
        for s in range(len(words) - width + 1):
            first["p", *words[s : s + width]] = min(i, first.get(("p", *words[s : s + width]), i))
    for (i, t, places, words, sentences), row in zip(read, rows, strict=True):
        lost, tails, seen = [False] * len(words), set(), set()
        for s, e in [x for x in sentences if x[1] - x[0] >= least]:
            if first["s", *words[s:e]] < i or tuple(words[s:e]) in seen:
                lost[s:e] = [True] * (e - s)
                tails.add(e - 1)
            seen.add(tuple(words[s:e]))
        for s in range(len(words) - width + 1):
            if first["p", *words[s : s + width]] < i:
                lost[s : s + width] = [True] * width
        spans = []
        for k, x in enumerate(lost):
            if x:
                end = places[k][1] if k not in tails else places[k + 1][0] if k + 1 < len(words) else len(t)
                if k and lost[k - 1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((places[k][0], end))
        edges = [0, *(x for s in spans for x in s), len(t)]
        yield row[0], tuple(spans), "".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def test_substring_dedup(docs, rows):
    got = Counter((r.doc_id, tuple((x["start"], x["end"]) for x in r.spans), r.text) for r in substring_dedup.dedup_units(docs).collect())
    want = Counter(substring_brute(rows))
    assert got == want
    assert sum(bool(spans) for _, spans, _ in want) > 15


def test_substring_dedup_of_odd_words(spark):
    rnd = random.Random(23)
    stock = [" ".join(rnd.choice(["a", "B", "b.", "c!", "É", "d\n", "e\t", "\u2028x", "f?", "日本"]) for _ in range(70)) for _ in range(12)]
    rows = []
    for k in range(160):
        cut = [(x := rnd.choice(stock))[rnd.randint(0, 60) : len(x) - rnd.randint(0, 60)] for _ in range(rnd.randint(0, 4))]
        rows.append((rnd.choice([k, k, k, 7, None]), rnd.choice([" ", "\n", " y ", ""]).join(cut) if cut else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, tuple((x["start"], x["end"]) for x in r.spans), r.text) for r in substring_dedup.dedup_units(df).collect())
    assert got == Counter(substring_brute(rows))


def test_substring_dedup_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: (spans, text) for i, spans, text in substring_brute(rows)}
    for r in substring_dedup.dedup_digests(docs).collect():
        spans, text = want[r.doc_id]
        assert (r.spans, r.n_removed_chars, r.kept_sha256) == (",".join(f"{s}:{e}" for s, e in spans), sum(e - s for s, e in spans), sha(text))


def test_substring_digests_are_of_the_kept_text(docs):
    kept = Counter((r.doc_id, sha(r.text)) for r in substring_dedup.dedup_units(docs).collect())
    assert kept == Counter((r.doc_id, r.kept_sha256) for r in substring_dedup.dedup_digests(docs).collect())


# --- no rows


def test_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    for out in (
        suffix_dedup.dedup_digests(empty), suffix_dedup.dedup_spans(empty), quality_rules.judge(empty, none), pii.find_spans(empty), pii.mask(empty), mixing.mix(empty), mixing.mixed(empty),
        simhash.near_duplicates(empty), simhash.representatives(empty), quality_classifier.classify(empty, none), quality_classifier.accepted(empty, none), packing.pack(empty), packing.encoded(empty),
        exact_dedup.exact_dedup(empty), line_dedup.dedup_lines(empty), line_dedup.cleaned(empty), substring_dedup.dedup_units(empty), substring_dedup.dedup_digests(empty), components.components(spark.createDataFrame([], "u long, v long")),
    ):
        assert out.collect() == []


def test_stages_keep_all_columns(docs, labels):
    for out in (quality_classifier.accepted(docs, labels), simhash.representatives(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        assert out.count() > 0


def test_mask(docs, spark):
    df = spark.createDataFrame([(1, "write to a@b.org or +1 (017) 555-7713 now"), (None, None)], "doc_id long, text string")
    assert {r.text for r in pii.mask(df).collect()} == {"write to <email> or <phone> now", ""}


def test_a_shared_passage_goes_to_the_word(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows, passages = [], {}
    for k in range(30):
        passage = words(51 + k)
        for c, p in enumerate((" ".join(passage.split()[: 30 + k]), passage, passage.upper())):  # the earliest holder has a part only
            rows.append((10 * k + c, f"{words(rnd.randint(1, 90))} {p}{' ' if c else chr(10)}{words(rnd.randint(1, 90))}"))
        passages[10 * k + 2] = passage
    rows += [(1000 + k, words(120)) for k in range(60)]
    got = {r.doc_id: r.n_removed_chars for r in substring_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == len(p) for i, p in passages.items())
    assert all(got[i] == 0 for i in got if i >= 1000 or i % 10 == 0)


def test_passages_are_found_by_their_anchors():
    from groundline.llm.passages import PASSAGE, Words

    rnd = random.Random(11)
    words = lambda n: ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(1, 8))) for _ in range(n)]
    for _ in range(30):
        shared = words(PASSAGE)
        x = Words([(" ".join(words(rnd.randint(0, 80)) + shared + ["é"] + words(rnd.randint(0, 80)))).encode() for _ in range(2)] + [b"", b"few words"])
        start, key = x.passages()
        at = [next(s for s in start if x.data[x.first[s] : x.last[s + PASSAGE - 1]].tobytes().split() == [w.encode() for w in shared] and x.doc[s] == d) for d in (0, 1)]
        assert key[start == at[0]] == key[start == at[1]] and len(set(key.tolist())) < len(key) / 3
        high, low = x.passage_digests(np.array(at))
        assert high[0] == high[1] and low[0] == low[1] and len(np.unique(x.passage_digests(start)[0])) == len(start) - 2  # "é" is shared, too
