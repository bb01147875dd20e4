"""Tokens, sentences, chunks and the rules that they share."""

import random

import pytest

import groundline as g
from groundline.functions.intervals import Interval
from groundline.functions.textops import collapsed, fold, for_match, strip, stringified
from groundline.operators import chunks, tokens
from groundline.sources import documents


def spans(text, tokenizer=g.UNICODE_TOKENS):
    return [(t["text"], t["start_pos"], t["end_pos"]) for t in g.tokenize(text, tokenizer)]


def test_tokens():
    assert [x[1:] for x in spans("Alpha  beta\nGamma", g.NON_SPACE_TOKENS)] == [(0, 5), (7, 11), (12, 17)]
    assert spans("Café costs €5.") == [("Café", 0, 4), ("costs", 5, 10), ("€", 11, 12), ("5", 12, 13), (".", 13, 14)]
    assert [x[0] for x in spans("don't 1,000.5 x_1 a-b 𝒳y éa")] == ["don't", "1,000.5", "x_1", "a-b", "𝒳y", "éa"]


def test_white_space_is_ascii_only():
    assert [x[0] for x in spans("a\x0bb c", g.NON_SPACE_TOKENS)] == ["a", "b c"]
    assert strip("\0 \n\x0bx  \0") == "x "
    assert collapsed(" a \t\n b  ") == "a b "


def test_lower_case_has_no_context():
    assert fold("ΑΣ") == "ας"[0] + "σ" and len(fold("İ")) == 2
    assert for_match("  Café \n X") == "café x"


@pytest.mark.parametrize(("value", "text"), [(True, "true"), (False, "false"), (1, "1"), (None, ""), ("x", "x"), ({"a": [1]}, '{"a": [1]}')])
def test_scalars_as_text(value, text):
    assert stringified(value) == text


def test_intervals():
    a = Interval(4, 6)
    assert not Interval(4, 4).overlaps(a) and Interval(4, 4).overlaps(Interval(3, 5)) and not a.overlaps(Interval(6, 7))
    assert a.shift(2) == Interval(6, 8) and len(a) == 2 and str(a) == "[4, 6)" and Interval(0, 9).contains(a)
    for bad in ((-1, 2), (3, 2)):
        with pytest.raises(ValueError):
            Interval(*bad)


@pytest.mark.parametrize(
    ("text", "most", "want"),
    [
        ("First sentence. Second sentence. Third.", 20, [(0, 16), (16, 33), (33, 39)]),
        ("Alpha beta gamma delta epsilon.", 12, [(0, 11), (11, 23), (23, 31)]),
        ('"Hello." Next sentence.', 20, [(0, 9), (9, 23)]),
        ("abcdefghijkl mnop", 12, [(0, 13), (13, 17)]),
        ("abcdefghijk. ", 12, [(0, 13), (13, 13)]),
        ("A\n\n \n\nB", 3, [(0, 3), (6, 7)]),
        ("", 5, []),
        (" \n ", 5, []),
    ],
)
def test_chunks(text, most, want):
    assert g.chunk_spans(text, most) == want


def test_chunk_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        g.chunk_spans("x", 0)
    with pytest.raises(ValueError):
        g.chunked(g.from_text(spark, "x"), 0)


def _texts():
    rnd = random.Random(1)
    parts = ["a", "Bb", "é", ". ", "!) ", "\n\n", " ", "?", "\t", "x9", "3.5", "'", "𝒳", "\x0b", " ", "."]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["", " "]


def test_chunk_invariants():
    for text in _texts():
        for most in (3, 7, 20):
            out = g.chunk_spans(text, most)
            assert all(e - s <= most + 1 for s, e in out)
            assert all(a[1] <= b[0] for a, b in zip(out, out[1:]))
            at = 0
            for s, e in out:
                assert not strip(text[at:s])
                at = e
            assert not strip(text[at:])


def test_native_tokens_and_sentences_are_the_kernels(spark):
    texts = _texts()
    docs = g.from_values(spark, texts)
    for pattern in (tokens.UNICODE, tokens.NON_SPACE):
        for form in (g.with_offsets(docs, pattern), g.token_rows(docs, tokens.Tokenizer(pattern))):
            got = {}
            for r in form.orderBy("doc_seq", "index").collect():
                assert r["index"] == len(got.setdefault(r.doc_seq, []))
                got[r.doc_seq].append((r.text, r.start_pos, r.end_pos))
            assert got == {i: x for i, t in enumerate(texts) if (x := spans(t, tokens.Tokenizer(pattern)))}
    for form in (g.sentences(docs), g.sentence_rows(docs)):
        got = {}
        for r in form.orderBy("doc_seq", "index").collect():
            assert r["index"] == len(got.setdefault(r.doc_seq, []))
            got[r.doc_seq].append((r.start_pos, r.end_pos))
        assert got == {i: x for i, t in enumerate(texts) if (x := chunks.sentence_spans(t))}


def test_rows_of_no_documents(spark):
    none = g.from_values(spark, ["x"]).limit(0)
    for form in (g.token_rows(none), g.with_offsets(none), g.sentence_rows(none), g.sentences(none), g.chunked(none)):
        assert form.collect() == []


def test_chunk_rows(spark):
    docs = g.from_values(spark, ["First sentence. Second.", {"text": "", "id": None}])
    got = g.chunked(docs, 16).orderBy("chunk_index").collect()
    assert [(r.text, r.tok_start, r.tok_end, r.document_id) for r in got] == [("First sentence. ", 0, 3, "document_0"), ("Second.", 3, 5, "document_0")]


def test_documents(spark):
    got = g.from_values(spark, ["x", {"text": "y", "id": 7, "metadata": {1: True}}, {"text": None}]).collect()
    assert [(r.doc_seq, r.id, r.text, r.metadata_json) for r in got] == [(0, "document_0", "x", "{}"), (1, "7", "y", '{"1": true}'), (2, None, "", "{}")]
    with pytest.raises(TypeError):
        g.from_values(spark, {"text": "x"})
    assert documents.spread(spark.range(1)).rdd.getNumPartitions() >= 1
