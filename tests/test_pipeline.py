"""End to end with offline models; merging, JSON lines, HTML, streams and the driver's entry."""

import json
import subprocess
import sys

import pytest

import groundline as g
from groundline.operators import merging
from groundline.operators.alignment import Taken
from groundline.plans import catalog
from groundline.sources import html, jsonl
from groundline.streaming import extract as streaming
from pyspark.sql import functions as F

APPLE = g.ConstantModel('{"extractions": [{"text": "Apple"}]}')


def spans(row):
    return [(x.text, x.alignment_status, x.char_interval and tuple(x.char_interval)) for x in row.extractions]


def test_text_form(spark):
    row = g.extract_text(spark, "Apple reported revenue of $94.8 billion.", APPLE, "Extract")
    assert row.id == "document_0" and spans(row) == [("Apple", "exact", (0, 5))]


def test_passes_are_merged(spark):
    row = g.extract(g.from_values(spark, ["Apple. Apple again."]), APPLE, "Extract", extraction_passes=2).first()
    assert spans(row) == [("Apple", "exact", (0, 5))]


def test_overlaps_and_threshold(spark):
    docs = g.from_values(spark, ["Apple reported revenue."])
    model = g.ConstantModel('[{"text": "Apple"}, {"text": "Apple reported"}]')
    assert [x[1] for x in spans(g.extract(docs, model, "E", allow_overlaps=True).first())] == ["exact", "exact"]
    assert len(spans(g.extract(docs, model, "E").first())) == 1
    fuzzy = g.extract(g.from_values(spark, ["Jonathan Smith works here."]), g.ConstantModel('[{"text": "Jonathon Smith"}]'), "E", fuzzy_threshold=0.99).first()
    assert spans(fuzzy) == [("Jonathon Smith", "ungrounded", None)]


def test_parse_errors(spark):
    docs = g.from_values(spark, ["Apple."])
    assert spans(g.extract(docs, g.ConstantModel("nope"), "E", suppress_parse_errors=True).first()) == []
    assert spans(g.extract(docs, g.ConstantModel("nope"), "E", strict=False).first()) == []
    with pytest.raises(Exception, match="unable to parse"):
        g.extract(docs, g.ConstantModel("nope"), "E").collect()


def test_bad_arguments(spark):
    docs = g.from_values(spark, ["Apple."])
    with pytest.raises(g.InvalidModelConfigError):
        g.extract(docs, object(), "E")
    with pytest.raises(ValueError):
        g.extract(docs, APPLE, "E", max_char_buffer=0)
    with pytest.raises(g.PromptValidationError):
        g.extract(docs, APPLE, "E", examples=[{"text": "a", "extractions": [{"text": "b"}]}], prompt_validation="error")


def test_both_plans_agree(spark, tmp_path):
    docs = g.from_values(spark, ["Anna met Bob. Carl saw Anna there! Dora left.", {"text": "nobody", "id": None}, ""])
    model = g.RegexModel({"name": r"[A-Z][a-z]+", "word": r"[a-z]{4,}"})
    options = {"extraction_passes": 2, "max_char_buffer": 16, "context_window_chars": 6}
    fused = g.extract(docs, model, "E", **options).orderBy("doc_seq").collect()
    outputs = g.model_outputs(docs, model, "E", path=str(tmp_path / "outputs"), **options)
    assert g.extract_from_outputs(docs, outputs, **options).orderBy("doc_seq").collect() == fused
    assert [x[0] for x in spans(fused[0])] == ["Anna", "Bob", "Carl", "Anna", "there", "Dora", "left"]
    assert spans(fused[2]) == []


def test_merge_is_the_native_form(spark):
    docs = g.from_values(spark, ["aaa bbb aaa ccc"])
    items = spark.createDataFrame([(0, i, t) for i, t in enumerate(["aaa", "aaa bbb", "bbb", "aaa", "zzzzzzz", "zzzzzzz", "ccc", "a ccc"])], "doc_seq long, item_index int, text string")
    annotated = g.annotate(docs, items)
    kernel = merging.merge([x.asDict(recursive=True) for x in annotated.first().extractions])
    rows = g.extraction_rows(annotated).select("doc_seq", "seq", "char_interval.*", "text", "description", "extraction_class", "extraction_index")
    native = merging.non_overlapping(merging.first_of_each(rows)).orderBy("seq").collect()
    assert [r.extraction_index for r in native] == [x["extraction_index"] for x in kernel]
    out = merging.regrouped(g.from_values(spark, ["x", "y"]).select("doc_seq"), rows).orderBy("doc_seq").collect()
    assert [len(r.extractions) for r in out] == [8, 0]


def test_taken():
    t = Taken()
    for s in ((5, 7), (0, 2), (9, 12)):
        assert not t.overlaps(s)
        t.add(s)
    assert [t.overlaps(s) for s in ((2, 5), (1, 3), (6, 6), (7, 9), (11, 20), (12, 13))] == [False, True, True, False, True, False]


def _annotated(spark):
    docs = g.from_values(spark, [{"text": 'Al <b> "q"\nö', "id": "d", "metadata": {"k": [1, None]}}, {"text": "x"}])
    items = spark.createDataFrame([(0, 0, "Al", "p&q", '{"n": 1.5}'), (0, 1, "zzzzz", None, None), (0, 2, '"q"\nö', None, None)], "doc_seq long, item_index int, text string, description string, attributes_json string")
    return g.annotate(docs, items)


def test_json_lines(spark, tmp_path):
    annotated = _annotated(spark)
    path = jsonl.save(annotated, str(tmp_path / "out"))
    back = jsonl.load(spark, path)
    assert sorted(map(str, back.drop("doc_seq").collect())) == sorted(map(str, annotated.drop("doc_seq").collect()))
    one = jsonl.save_file(annotated, str(tmp_path / "one.jsonl"))
    lines = [json.loads(x) for x in open(one, encoding="utf-8")]
    folder = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in open(f, encoding="utf-8")]
    assert sorted(map(str, lines)) == sorted(map(str, folder))
    assert list(lines[0]["extractions"][1]) == ["extraction_class", "text", "description", "attributes", "char_interval", "token_interval", "alignment_status", "extraction_index", "group_id", "document_id"]


def test_json_lines_forms_and_failures(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"id": "a", "text": "T", "extractions": [{"type": "c", "extraction_text": "t"}]}\n \n{"document": {"text": "U"}, "extractions": [{"extraction_class": null, "class": "c", "text": "u"}]}\n')
    a, b = jsonl.load(spark, str(f)).orderBy("doc_seq").collect()
    assert (a.id, a.text, a.extractions[0].extraction_class, a.extractions[0].text, a.extractions[0].alignment_status) == ("a", "T", "c", "t", "ungrounded")
    assert b.id is None and b.extractions[0].extraction_class is None
    f.write_text("{bad\n")
    for path in (str(f), str(tmp_path / "missing")):
        with pytest.raises(g.IOFailure):
            jsonl.load(spark, path)
    with pytest.raises(g.IOFailure):
        jsonl.save_file(_annotated(spark), str(tmp_path))


def test_html(spark, tmp_path):
    annotated = _annotated(spark)
    page = g.visualize(annotated)
    assert page.startswith("<!doctype html>") and "<h1>d</h1>" in page and "<h1>Document</h1>" in page
    assert '<mark data-status="exact">Al<span class="label">p&amp;q</span></mark> &lt;b&gt; ' in page
    assert '<mark data-status="exact">&quot;q&quot;ö<span class="label">extraction</span></mark>' in page  # no line end within a mark
    path = jsonl.save_file(annotated, str(tmp_path / "a.jsonl"))
    assert g.visualize(path) == page
    rows = annotated.orderBy("doc_seq").collect()
    assert g.visualize(rows) == page == g.visualize([jsonl.to_object(r.asDict(recursive=True)) for r in rows])
    assert g.visualize(rows[0]) == html.HEAD + html.section("d", rows[0].text, rows[0].asDict(recursive=True)["extractions"]) + html.TAIL
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(g.IOFailure):
        g.visualize(str(tmp_path / "empty.jsonl"))
    assert html.escaped("'") == "&#39;"


def test_stream(spark, tmp_path):
    g.from_values(spark, ["Apple. Bob.", "Apple"]).write.parquet(str(tmp_path / "in"))
    docs = streaming.read_documents(spark, str(tmp_path / "in"))
    query = streaming.write_lines(streaming.extract_stream(docs, APPLE, "E"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    got = jsonl.load(spark, str(tmp_path / "out"))
    assert sorted((r.text, len(r.extractions)) for r in got.collect()) == [("Apple", 1), ("Apple. Bob.", 1)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, agree, name):
    agree(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"), duck, catalog.ORACLE_SQL[name])


def test_fuzzy_query_spans_reach_the_threshold(spark):
    from groundline.functions.similarity import similarity
    from groundline.functions.textops import for_match

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = catalog.fuzzy_align(spark, "/root/testdata/sf0.001").where(F.col("alignment_status") == "fuzzy").collect()
    assert rows
    for r in rows:
        assert similarity(for_match(r.text), for_match(texts[r.doc_seq][r.start_pos : r.end_pos])) >= 0.78


def test_fuzzy_and_exact_matches_together(spark):
    from groundline.functions.similarity import similarity
    from groundline.functions.textops import for_match

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    place = lambda r: (r.doc_seq, r.extraction_index)
    plain = {place(r): r for r in catalog.overlap_status(spark, sf).collect()}
    rows = catalog.overlap_status_fuzzy(spark, sf).collect()
    assert {place(r) for r in rows} == set(plain) and any(r.alignment_status == "fuzzy" for r in rows)
    kept = {}
    for r in rows:
        if r.alignment_status == "fuzzy":
            assert similarity(for_match(r.text), for_match(texts[r.doc_seq][r.start_pos : r.end_pos])) >= 0.78
        if r.alignment_status in ("exact", "fuzzy"):
            assert all(r.end_pos <= s or e <= r.start_pos for s, e in kept.setdefault(r.doc_seq, []))
            kept[r.doc_seq].append((r.start_pos, r.end_pos))


def test_filters_and_columns_reach_the_scan(spark):
    docs = g.from_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'"))
    plan = g.with_offsets(docs)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_training_data_operators(tmp_path):
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    (tmp_path / "groundline").mkdir()
    for p in (root / "groundline").iterdir():
        if p.name != "llm":
            (tmp_path / "groundline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == [str(len(catalog.QUERIES)), "False"], said.stderr
    # the other tests pass there, too (those that start no session of their own take long enough)
    (tmp_path / "tests").mkdir()
    for p in (root / "tests").glob("*.py"):
        (tmp_path / "tests" / p.name).write_text(p.read_text())
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_text.py", "tests/test_formats.py", "tests/test_alignment.py"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout[-2000:]
