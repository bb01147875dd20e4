"""Alignment: the cases that its rules were written down with, and what must hold for any text."""

import random

import pytest

import groundline as g
from groundline.functions.similarity import similarity
from groundline.operators import alignment
from pyspark.sql import functions as F


def aligned(text, *items, **options):
    out = g.Aligner(text, **options).align([{"text": x} for x in items])
    return [(x["alignment_status"], x["char_interval"] and tuple(x["char_interval"].values())) for x in out]


@pytest.mark.parametrize(
    ("text", "items", "want"),
    [
        ("Alice met Bob.", ["Bob"], [("exact", (10, 13))]),
        ("Alice met Bob.", ["alice"], [("exact", (0, 5))]),
        ("Jonathon Smith met Jonathon Smith.", ["Jonathan Smith"] * 2, [("fuzzy", (0, 14)), ("fuzzy", (19, 33))]),
        ("New York reported results.", ["New   York"], [("fuzzy", (0, 8))]),
        ("Café reported results.", ["Café"], [("fuzzy", (0, 5))]),
        ("Alice met Bob.", ["Alice", "Alice"], [("exact", (0, 5)), ("overlap", (0, 5))]),
        ("Alice met Bob.", ["Charlie"], [("ungrounded", None)]),
        ("Alice met Bob.", ["", " \n"], [("ungrounded", None)] * 2),
        ("aaa", ["aa", "aa"], [("exact", (0, 2)), ("overlap", (0, 2))]),
        ("aaaa", ["aa", "aa"], [("exact", (0, 2)), ("exact", (2, 4))]),
    ],
)
def test_cases(text, items, want):
    assert aligned(text, *items) == want


def test_fuzzy_start():
    assert aligned("Jonathan Smith signed the contract.", "Jonathon Smith")[0][1][0] == 0
    assert aligned("filler " * 1000 + "Jonathon Smith", "Jonathan Smith")[0][1][0] == 7000
    assert aligned("Jonathan Smith works here.", "Jonathon Smith", threshold=0.99) == [("ungrounded", None)]


def test_tokens_of_a_span():
    assert g.Aligner("Alice met Bob.").align([{"text": "Bob"}])[0]["token_interval"] == {"start_pos": 2, "end_pos": 3}


def test_overlaps_allowed():
    assert aligned("Alice met Bob.", "Alice", "Alice met", allow_overlaps=True) == [("exact", (0, 5)), ("exact", (0, 9))]


def test_errors_are_raised_on_request():
    with pytest.raises(g.AlignmentError):
        aligned("Alice met Bob.", "Charlie", suppress_errors=False)


def test_case_insensitive_in_the_preferred_chunk_beats_exact_elsewhere():
    assert g.Aligner("APPLE x. Apple y.").place("Apple", (0, 9)) == ((0, 5), "exact")
    assert g.Aligner("APPLE x. Apple y.").place("Apple") == ((9, 14), "exact")


def test_similarity():
    assert similarity("abcd", "bcde") == 0.75 and similarity("", "x") == 0.0 and similarity("", "") == 1.0
    assert similarity("tide", "diet") != similarity("diet", "tide")
    assert similarity("a" * 300, "a" * 299 + "b") > 0.99  # frequent characters count


def test_window_lengths_are_in_binary_doubles():
    import math

    assert math.ceil(180 * alignment.LONGEST) == 244


def test_any_text():
    rnd = random.Random(0)
    for _ in range(150):
        text = "".join(rnd.choice(["ab", "Ba ", "c", " d", "É", "\n", "the "]) for _ in range(rnd.randint(1, 40)))
        items = ["".join(rnd.choice("abcd É") for _ in range(rnd.randint(1, 6))) for _ in range(6)]
        out = g.Aligner(text).align([{"text": x} for x in items])
        kept = [tuple(x["char_interval"].values()) for x in out if x["alignment_status"] in ("exact", "fuzzy")]
        assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(kept) for b in kept[:i])
        for x in out:
            if x["alignment_status"] == "exact":
                s, e = x["char_interval"].values()
                assert text[s:e].lower() == x["text"].lower()


def test_annotate(spark):
    docs = g.from_values(spark, ["Alice met Bob.", "nothing here"])
    items = spark.createDataFrame([(0, 1, "Bob", "person"), (0, 0, "alice", None)], "doc_seq long, item_index int, text string, extraction_class string")
    a, b = g.annotate(docs, items).orderBy("doc_seq").collect()
    assert [(x.text, x.extraction_class, x.alignment_status, tuple(x.char_interval), x.extraction_index, x.document_id) for x in a.extractions] == [
        ("alice", None, "exact", (0, 5), 0, "document_0"),
        ("Bob", "person", "exact", (10, 13), 1, "document_0"),
    ]
    assert b.extractions == []


def test_occurrences(spark):
    pairs = [("aaa", "aa"), ("abab", "ab"), ("x\\Ey\\E", "\\E"), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("é.é.", "."), ("𝒳a𝒳", "𝒳"), ("a\nb\nb", "b"), ("(a(", "("), ("a" * 30_000, "aaa")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "doc_seq long, text string, target string")
    got = sorted((r.doc_seq, r.target, r.start_pos) for r in alignment.occurrence_rows(df).collect())
    assert got == [(k, t, i) for k, (x, t) in enumerate(pairs) if x and t for i in range(len(x)) if x.startswith(t, i)]
    assert alignment.occurrence_rows(df.limit(0)).collect() == []
