"""Driver queries over the shared tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import similarity_column
from ..functions.textops import WS
from ..operators import alignment, chunks, merging, models, parsing, prompts, tokens
from ..operators.models import ConstantModel, RegexModel
from ..sources import documents, html, jsonl
from . import pipeline

TASK, WINDOW = "Extract names", 40
TARGETS = ("of the", "the", "The", "the")
LOOKED_FOR = ("the", "ere", "de la", "anan")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SCHEMA = {"required": ["extraction_class"], "properties": {"text": {"type": "string"}, "attributes": {"type": "object"}}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.spread(documents.from_table(_table(spark, sf_dir, "documents"), metadata=("lang", "source")))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that the cluster shares; a local one only where all executors are threads of this process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="groundline-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokens_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(_docs(spark, sf_dir), tokens.NON_SPACE_TOKENS)


def tokens_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(_docs(spark, sf_dir))


def tokens_unicode_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_offsets(_docs(spark, sf_dir))


def token_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.spread(_table(spark, sf_dir, "documents").select("lang", "text"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(tokens.counted(F.col("text")).cast("long")).alias("n_tokens"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sentence_rows(_docs(spark, sf_dir))


def sentences_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sentences(_docs(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    return chunks.chunked(_docs(spark, sf_dir), most)


def chunks_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 2000).select("doc_seq", "chunk_index", "start_pos", "end_pos", "text")


def chunks_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 200).select("doc_seq", "chunk_index", "start_pos", "end_pos", "text")


def chunk_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 2000).select("doc_seq", "chunk_index", "tok_start", "tok_end")


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompts(chunks.chunked(_docs(spark, sf_dir), 2000, context_window_chars=WINDOW), None, TASK, additional_context="Invented prose", context_window_chars=WINDOW, passes=2)


EXAMPLES = ({"text": "Ann met Bo", "extractions": [{"text": "Ann", "extraction_class": "name"}]}, {"text": "Nobody came", "extractions": []})


def prompt_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with few-shot examples and no context."""
    return prompts.prompts(chunks.chunked(_docs(spark, sf_dir), 2000), None, TASK, examples=list(EXAMPLES), validation="off").select("doc_seq", "chunk_index", "prompt")


def example_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an example whose extraction is the first word of the turn after it."""
    from pyspark.sql import Window

    turns = _table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = turns.withColumn("wanted", F.regexp_extract(F.coalesce(after, F.lit("")), f"[^{WS}]+", 0))
    return turns.select("conv_id", "turn", prompts.issue_column(F.col("text"), F.col("wanted")).alias("issue"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers, made up from labels: prose with two fenced blocks."""
    text = F.format_string(
        'So:\n```json\n{"extractions": [{"class": %s, "text": "q%d", "attributes": {"doc": %d}}, null, {"extraction_class": "toxic", "extraction_text": "t%d"}]}\n```\nor ```YAML\n- text: q%d\n```',
        F.when(F.col("quality") == 1, F.lit('"good"')).otherwise(F.lit("null")), "quality", "doc_id", "toxic", "quality",
    )
    return _table(spark, sf_dir, "labels").select("doc_id", text.alias("output_text"))


def fenced_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("doc_id", F.posexplode(parsing.payload_column(F.col("output_text"))).alias("block", "payload"))


def parse_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.item_rows(parsing.parsed(_outputs(spark, sf_dir))).drop("output_text")


def json_items_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.get(parsing.payload_column(F.col("output_text")), F.lit(0))
    out = _outputs(spark, sf_dir).select("doc_id", F.posexplode(parsing.json_items(block)).alias("item_index", "x")).select("doc_id", "item_index", "x.*")
    return out.where("text is not null")


#: Forms of answers, one for each remainder of doc_id: the payload around an item, or one that can't be read.
FORMS = (
    '{{"data": [{0}]}}', '{{"items": [{0}, null]}}', "{0}", "Here:\n```json\n[{0}, {0}]\n```", '{{"extractions": [{0}, 7]}}', "no payload at all: [", '{{"extractions": []}}',
    "```yaml\nextractions:\n- type: k{1}\n  extraction_text: t{1}\n  attributes:\n    n: {1}\n```", "```\n- text: {1}\n```", '```json\n{{bad\n```\nand ```json\n{{"text": "second {1}"}}\n```',
)


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('{"type": "k%d", "text": "q%d", "description": "d", "group_id": %d, "attributes": {"x": true}}', "doc_id", "quality", "toxic")
    made = [F.concat(*_filled(f, item, F.col("doc_id").cast("string"))) for f in FORMS]
    return _table(spark, sf_dir, "labels").select("doc_id", F.get(F.array(*made), F.pmod("doc_id", F.lit(len(FORMS))).cast("int")).alias("output_text"))


def _filled(form: str, *values) -> list:
    """Pieces of a format string with columns at its places."""
    pieces = re.split(r"(\{\d\})", form.replace("{{", "\0").replace("}}", "\1"))
    return [values[int(x[1])] if re.fullmatch(r"\{\d\}", x) else F.lit(x.replace("\0", "{").replace("\1", "}")) for x in pieces]


def parse_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.item_rows(parsing.parsed(_forms(spark, sf_dir))).drop("output_text")


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each answer gives, and whether it is an error."""
    return parsing.parsed(_forms(spark, sf_dir)).select("doc_id", F.size("items").alias("n_items"), F.col("parse_error").isNotNull().alias("failed"))


def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of the wrong type."""
    schema = {"properties": {"group_id": {"type": "string"}, "attributes": {"type": "object"}}}
    text = F.format_string('[{"text": "a", "group_id": "g"}, {"text": "b", "group_id": %s}]', F.when(F.col("quality") == 1, F.lit('"g"')).otherwise(F.lit("3")))
    outputs = _table(spark, sf_dir, "labels").select("doc_id", text.alias("output_text"))
    return parsing.parsed(outputs, schema=schema).select("doc_id", F.size("items").alias("n_items"), "parse_error")


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parsed(_outputs(spark, sf_dir), schema=SCHEMA).select("doc_id", F.size("items").alias("n_items"), "parse_error")


def exact_all_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("target", F.explode(F.array(*map(F.lit, LOOKED_FOR))))
    return alignment.occurrence_rows(docs)


def exact_first_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("target", F.explode(F.array(*map(F.lit, LOOKED_FOR))))
    return docs.select("doc_seq", "target", alignment.first_without_case(F.col("text"), F.upper("target")).alias("start_pos"))


def _items(docs: DataFrame, *texts) -> DataFrame:
    return docs.select("doc_seq", F.posexplode(F.array(*texts)).alias("item_index", "text"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    # a threshold above 1 leaves out fuzzy matches, so that SQL can say the same
    return alignment.annotate(docs, _items(docs, *map(F.lit, TARGETS)), threshold=1.01)


def overlap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.extraction_rows(_annotated(spark, sf_dir))
    return rows.select("doc_seq", "extraction_index", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


def overlap_status_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``overlap_status`` with the default threshold, so with fuzzy matches; SQL can't say it."""
    docs = _docs(spark, sf_dir)
    rows = pipeline.extraction_rows(alignment.annotate(docs, _items(docs, *map(F.lit, TARGETS))))
    return rows.select("doc_seq", "extraction_index", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that each extraction covers."""
    rows = pipeline.extraction_rows(_annotated(spark, sf_dir))
    return rows.select("doc_seq", "extraction_index", F.col("token_interval.start_pos").alias("tok_start"), F.col("token_interval.end_pos").alias("tok_end"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents: a sentence about each, with a decomposed accent."""
    text = F.concat("p_name", F.lit(" of "), "p_type", F.lit(", "), "p_brand", F.lit(" cafe\u0301"))
    return documents.spread(documents.from_table(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", text.alias("text")), seq="p_partkey"))


def fuzzy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names, twice, so that the second finds the first's place taken; an accent composed otherwise; a brand as it is."""
    return _fuzzy_parts(spark, sf_dir)


def fuzzy_parts_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by another tokenizer and threshold."""
    return _fuzzy_parts(spark, sf_dir, tokenizer=tokens.NON_SPACE_TOKENS, threshold=0.7)


def _fuzzy_parts(spark: SparkSession, sf_dir: str, **kept) -> DataFrame:
    docs = _parts(spark, sf_dir)
    name = F.regexp_extract("text", "^(.*) of ", 1)
    items = _items(docs, F.translate(name, "aei", "xxx"), F.translate(name, "ou", "yy"), F.lit("CAF\u00c9"), F.regexp_extract("text", ", (.*) ", 1), F.concat(F.lit("the "), name))
    rows = pipeline.extraction_rows(alignment.annotate(docs, items, **kept))
    return rows.select("doc_seq", "extraction_index", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its letters in another order and its type."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.translate("p_name", "aeioulr", "eiouarl"), F.lit(" "), F.lower("p_type")).alias("b"))
    return parts.select("p_partkey", similarity_column(F.col("a"), F.col("b")).alias("forth"), similarity_column(F.col("b"), F.col("a")).alias("back"))


def annotate_counts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.extraction_rows(_annotated(spark, sf_dir))
    return rows.groupBy("alignment_status").agg(F.count("*").alias("n"))


def fuzzy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelled form of each document's own words, found again."""
    docs = _docs(spark, sf_dir)
    own = F.regexp_replace(F.substring("text", 1, 14), "[eo]", "x")
    rows = pipeline.extraction_rows(alignment.annotate(docs, _items(docs, own)))
    return rows.select("doc_seq", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction-like rows made up from events: user_id as the document."""
    e = _table(spark, sf_dir, "events")
    start = (F.col("event_id") * 7 % 50).cast("int")
    return e.select(
        F.col("user_id").alias("doc_seq"), F.col("event_id").alias("seq"), start.alias("start_pos"), (start + 1 + F.col("event_id") % 5).cast("int").alias("end_pos"),
        F.col("event_type").alias("text"), F.lit(None).cast("string").alias("description"), F.when(F.col("event_id") % 3 > 0, "a").alias("extraction_class"),
    )


def merge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.first_of_each(_spans(spark, sf_dir))


def merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merging.first_of_each(_spans(spark, sf_dir)).select("doc_seq", "seq", "start_pos", "end_pos")
    return merging.non_overlapping(rows)


def merge_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, most of which have no rows."""
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_seq"))
    rows = merging.non_overlapping(_spans(spark, sf_dir).select("doc_seq", "seq", "start_pos", "end_pos"))
    return merging.regrouped(docs, rows).select("doc_seq", F.size("extractions").cast("long").alias("n"))


def extract_regex_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.extract(_docs(spark, sf_dir), RegexModel({"email": EMAIL}), TASK, extraction_passes=2, prompt_validation="off")
    rows = pipeline.extraction_rows(out)
    return rows.select("doc_seq", "extraction_class", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


class _ByPattern(models.Provider):
    """An adapter of the tests: the pattern is an option."""

    def infer(self, prompt: str) -> models.InferenceResult:
        return RegexModel({"email": self.config.options["pattern"]}).infer(prompt)


def extract_by_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_regex_model`` with a model that the router makes from its configuration, whose answers are written first; one pass."""
    models.router().register("pattern", _ByPattern)
    model = models.create_model(models.ModelConfig(adapter="pattern", model="m", options={"pattern": EMAIL}))
    docs = _docs(spark, sf_dir)
    outputs = pipeline.model_outputs(docs, model, TASK, prompt_validation="off")
    rows = pipeline.extraction_rows(pipeline.extract_from_outputs(docs, outputs))
    return rows.select("doc_seq", "extraction_class", "text", "alignment_status", F.col("char_interval.start_pos").alias("start_pos"), F.col("char_interval.end_pos").alias("end_pos"))


#: Driver values: objects with and without an id, a plain value and a number.
VALUES = ({"id": "a", "text": "one text", "metadata": {"k": 1}}, {"text": "no id"}, "a plain text", 7)


def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of driver values, and one of a text."""
    one = documents.from_text(spark, "only text").withColumn("doc_seq", F.col("doc_seq") - 1)
    return documents.from_values(spark, VALUES).union(one)


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page of the regions, each with a mark, line by line."""
    docs = documents.from_table(_table(spark, sf_dir, "region"), seq="r_regionkey", text="r_name")
    annotated = alignment.annotate(docs, _items(docs, F.substring("text", 1, 3)), threshold=1.01)
    lines = html.visualize(annotated).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, html string")


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("extractions", F.array().cast("array<string>"))
    annotated = alignment.annotate(docs.drop("extractions"), _items(docs, F.substring("text", 1, 5)), threshold=1.01)
    back = jsonl.load(spark, jsonl.save(annotated, _folder(spark, "jsonl")))
    return back.select("id", "text", F.size("extractions").alias("n_extractions"), F.get_json_object("metadata_json", "$.lang").alias("lang"))


def render_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return html.sections(alignment.annotate(docs, _items(docs, F.lit("the")), threshold=1.01))


def render_clashing_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several marks a document with classes, of which some clash: of equal or overlapping ones the first by start is shown."""
    docs = _parts(spark, sf_dir)
    items = docs.select("doc_seq", F.posexplode(F.array(*[F.struct(t.alias("text"), F.lit(c).alias("extraction_class")) for t, c in ((F.lit(" of "), "a&b"), (F.lit("of"), "inside"), (F.regexp_extract("text", ", (.*) ", 1), "brand"))])).alias("item_index", "x"))
    return html.sections(alignment.annotate(docs, items.select("doc_seq", "item_index", "x.*"), threshold=1.01, allow_overlaps=True))


def extract_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that can't be read give no extractions if parsing is lenient, nor if errors are suppressed."""
    docs = _docs(spark, sf_dir)
    out = [pipeline.extract(docs, ConstantModel("no payload: ["), TASK, prompt_validation="off", **kept).select("doc_seq", F.size("extractions").alias("n")) for kept in ({"strict": False}, {"suppress_parse_errors": True})]
    return out[0].union(out[1]).groupBy("doc_seq").agg(F.sum("n").alias("n_extractions"), F.count("*").alias("n_runs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_ws, tokens_unicode, tokens_unicode_native, token_counts_by_lang, sentences, sentences_native, chunks_2000, chunks_200, chunk_token_spans, prompt_context, prompt_examples, example_issues,
        fenced_payloads, parse_json_items, json_items_native, parse_forms, parse_failures, schema_violations, schema_types, exact_all_occurrences, exact_first_ci, overlap_status, overlap_status_fuzzy, token_intervals, fuzzy_parts, fuzzy_parts_ws, similarity_pairs,
        annotate_counts_by_status, fuzzy_align, merge_distinct, merge_greedy, merge_regroup, extract_regex_model, extract_by_adapter, extract_lenient, source_values, jsonl_roundtrip, render_marks, render_clashing_marks, page,
    )
}

_B = chunks.BOUNDARY.replace("'", "''")
_U = tokens.UNICODE.replace("'", "''")


def _token_sql(pattern: str) -> str:
    return rf"""
        WITH t AS (
          SELECT doc_id AS doc_seq, unnest(regexp_extract_all(text, '([{WS}]*)({pattern})', 1)) AS gap, unnest(regexp_extract_all(text, '([{WS}]*)({pattern})', 2)) AS text,
                 generate_subscripts(regexp_extract_all(text, '([{WS}]*)({pattern})', 2), 1) - 1 AS i FROM documents),
        o AS (SELECT *, sum(length(gap) + length(text)) OVER (PARTITION BY doc_seq ORDER BY i) AS e FROM t)
        SELECT doc_seq, i::INT AS "index", text, (e - length(text))::INT AS start_pos, e::INT AS end_pos FROM o"""


_SENTENCES = rf"""
        tiled AS (
          SELECT doc_id AS doc_seq, unnest(regexp_extract_all(text, '(?s).*?(?:{_B})|(?s).+\z')) AS s,
                 generate_subscripts(regexp_extract_all(text, '(?s).*?(?:{_B})|(?s).+\z'), 1) AS i FROM documents),
        placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_seq ORDER BY i) AS e FROM tiled),
        sent AS (
          SELECT doc_seq, i, s AS t, (e - length(s))::BIGINT AS s, e::BIGINT AS e FROM placed
          WHERE regexp_matches(s, '[^{WS}\x00]'))"""


def _chunk_sql(most: int) -> str:
    """Sentences cut to pieces by recursion, then folded into chunks."""
    cut = lambda at: rf"{at} + CASE WHEN regexp_matches(substr(t, {at} - s + 2, {most}), '[{WS}]') THEN length(regexp_extract(substr(t, {at} - s + 2, {most}), '(?s)^.*[{WS}]')) + 1 ELSE {most} END"
    return rf"""{_SENTENCES},
        piece AS (
          SELECT doc_seq, i, t, s, e, s AS ps, (CASE WHEN e - s > {most} THEN {cut("s")} ELSE e END)::BIGINT AS pe, e - s <= {most} AS last FROM sent
          UNION ALL
          SELECT doc_seq, i, t, s, e, pe, (CASE WHEN e - pe > {most} THEN {cut("pe")} ELSE e END)::BIGINT, e - pe <= {most} FROM piece WHERE NOT last),
        folded AS (
          SELECT doc_seq, list_reduce(list({{'s': s, 'e': e, 'ps': ps, 'pe': pe, 'last': last, 'out': []::STRUCT(a BIGINT, b BIGINT)[], 'cs': -1::BIGINT, 'ce': -1::BIGINT}} ORDER BY i, ps, last), lambda acc, x:
            {{'s': x.s, 'e': x.e, 'ps': x.ps, 'pe': x.pe, 'last': x.last,
             'out': list_concat(list_concat(acc.out, CASE WHEN x.ps = x.s AND acc.s <> x.s AND acc.ce >= 0 AND x.e - acc.cs > {most} THEN [{{'a': acc.cs, 'b': acc.ce}}] ELSE [] END),
                                CASE WHEN x.last THEN [] ELSE [{{'a': x.ps, 'b': x.pe}}] END),
             'cs': CASE WHEN NOT x.last THEN x.pe WHEN x.ps = x.s AND acc.s <> x.s AND (acc.ce < 0 OR x.e - acc.cs > {most}) THEN x.s WHEN acc.cs < 0 THEN x.s ELSE acc.cs END,
             'ce': x.e}},
            {{'s': -1::BIGINT, 'e': -1::BIGINT, 'ps': -1::BIGINT, 'pe': -1::BIGINT, 'last': false, 'out': []::STRUCT(a BIGINT, b BIGINT)[], 'cs': -1::BIGINT, 'ce': -1::BIGINT}}) AS f FROM piece GROUP BY doc_seq),
        spans AS (SELECT doc_seq, list_append(f.out, {{'a': f.cs, 'b': f.ce}}) AS l FROM folded),
        chunk AS (SELECT doc_seq, (generate_subscripts(l, 1) - 1)::INT AS chunk_index, unnest(l).a::INT AS start_pos, unnest(l).b::INT AS end_pos FROM spans)"""


def _chunk_rows(most: int) -> str:
    return f"""WITH RECURSIVE {_chunk_sql(most)}
        SELECT doc_seq, chunk_index, start_pos, end_pos, substr(text, start_pos + 1, end_pos - start_pos) AS text FROM chunk JOIN documents ON doc_id = doc_seq"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_OUTPUTS = """
        out AS (
          SELECT doc_id, quality, toxic, 'So:' || chr(10) || '```json' || chr(10) || '{"extractions": [{"class": ' || CASE WHEN quality = 1 THEN '"good"' ELSE 'null' END || ', "text": "q' || quality
                 || '", "attributes": {"doc": ' || doc_id || '}}, null, {"extraction_class": "toxic", "extraction_text": "t' || toxic || '"}]}' || chr(10) || '```' || chr(10)
                 || 'or ```YAML' || chr(10) || '- text: q' || quality || chr(10) || '```' AS o FROM labels)"""

_SPANS = """
        spans AS (
          SELECT user_id AS doc_seq, event_id AS seq, (event_id * 7 % 50)::INT AS start_pos, (event_id * 7 % 50 + 1 + event_id % 5)::INT AS end_pos,
                 event_type AS text, NULL::VARCHAR AS description, CASE WHEN event_id % 3 > 0 THEN 'a' END AS extraction_class FROM events)"""


def _greedy(rows: str) -> str:
    return f"""
        kept AS (
          SELECT doc_seq, list_reduce(list({{'x': {{'seq': seq, 's': start_pos, 'e': end_pos}}, 'out': []::STRUCT(seq BIGINT, s INT, e INT)[]}} ORDER BY seq), lambda acc, y:
            {{'x': y.x, 'out': CASE WHEN len(list_filter(acc.out, lambda k: k.s < y.x.e AND y.x.s < k.e)) > 0 THEN acc.out ELSE list_append(acc.out, y.x) END}},
            {{'x': {{'seq': -1::BIGINT, 's': 0, 'e': 0}}, 'out': []::STRUCT(seq BIGINT, s INT, e INT)[]}}).out AS l FROM {rows} GROUP BY doc_seq)"""


_FIRST = "firsts AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY doc_seq, start_pos, end_pos, text, description, extraction_class ORDER BY seq) = 1)"

#: Each document's items one after the other: the first occurrence that no earlier item took, else the first as overlap.
_ALIGNED = f"""
        item AS (SELECT doc_id AS doc_seq, text, unnest({list(TARGETS)!r}) AS t, unnest(range(0, {len(TARGETS)})) AS k FROM documents),
        found AS (
          SELECT doc_seq, k, t, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(t)) = t) AS exact, strpos(lower(text), lower(t)) - 1 AS ci FROM item),
        places AS (SELECT doc_seq, k, t, CASE WHEN len(exact) > 0 THEN exact WHEN ci >= 0 THEN [ci] ELSE [] END AS p FROM found),
        folded AS (
          SELECT doc_seq, list_reduce(list({{'t': t, 'p': p, 'taken': []::STRUCT(s BIGINT, e BIGINT)[], 'out': []::STRUCT(s BIGINT, st VARCHAR)[]}} ORDER BY k), lambda acc, x:
            {{'t': x.t, 'p': x.p,
             'taken': CASE WHEN len(list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i + length(x.t) AND i < o.e)) = 0)) > 0
               THEN list_append(acc.taken, {{'s': list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i + length(x.t) AND i < o.e)) = 0)[1],
                                            'e': list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i + length(x.t) AND i < o.e)) = 0)[1] + length(x.t)}}) ELSE acc.taken END,
             'out': list_append(acc.out, CASE WHEN len(x.p) = 0 THEN {{'s': NULL::BIGINT, 'st': 'ungrounded'}}
               WHEN len(list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i + length(x.t) AND i < o.e)) = 0)) > 0
               THEN {{'s': list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i + length(x.t) AND i < o.e)) = 0)[1], 'st': 'exact'}}
               ELSE {{'s': x.p[1], 'st': 'overlap'}} END)}},
            {{'t': '', 'p': []::BIGINT[], 'taken': []::STRUCT(s BIGINT, e BIGINT)[], 'out': []::STRUCT(s BIGINT, st VARCHAR)[]}}).out AS l FROM places GROUP BY doc_seq),
        aligned AS (
          SELECT doc_seq, unnest(range(0, {len(TARGETS)}))::INT AS extraction_index, unnest({list(TARGETS)!r}) AS text, unnest(l).st AS alignment_status, unnest(l).s::INT AS start_pos FROM folded)"""

#: Parts as documents, under the name that the statements here read.
_PARTS = "documents AS (SELECT p_partkey AS doc_id, p_name, p_brand, p_name || ' of ' || p_type || ', ' || p_brand || ' cafe' || chr(769) AS text FROM part)"

#: matched (a, b, r): the similarity of each pair (a, b) in ``pairs``: the longest common stretch, the earliest in a and then in b, and again on both sides of it.
_SIMILAR = """
        work AS (
          SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi, 0::BIGINT AS m FROM pairs
          UNION ALL
          SELECT a, b, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) FROM (
            SELECT a, b, alo, ahi, blo, bhi, i, k, blo + strpos(substr(b, blo + 1, bhi - blo), substr(a, i + 1, k)) - 1 AS j
            FROM (SELECT *, unnest(range(1, least(ahi - i, bhi - blo) + 1)) AS k FROM (SELECT *, unnest(range(alo, ahi)) AS i FROM work WHERE bhi > blo))
            WHERE strpos(substr(b, blo + 1, bhi - blo), substr(a, i + 1, k)) > 0
            QUALIFY row_number() OVER (PARTITION BY a, b, alo, ahi, blo, bhi ORDER BY k DESC, i) = 1)),
        matched AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS r FROM work GROUP BY a, b)"""


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({x})), '[{WS}]+', ' ', 'g'))"


def _fuzzy(pattern: str, threshold: float) -> str:
    """The items of ``fuzzy_parts``: exact, without case, then windows at tokens by their similarity; each in the first place that no earlier item took."""
    return rf"""
        token AS ({_token_sql(pattern)}),
        item AS (
          SELECT doc_id AS doc_seq, text, unnest([translate(p_name, 'aei', 'xxx'), translate(p_name, 'ou', 'yy'), 'CAF' || chr(201), p_brand, 'the ' || p_name]) AS t, unnest(range(0, 5)) AS k FROM documents),
        plain AS (
          SELECT *, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(t)) = t) AS exact, strpos(lower(text), lower(t)) - 1 AS ci,
                 greatest(1, floor(length(t) * 0.65::DOUBLE))::BIGINT AS shortest, ceil(length(t) * 1.35::DOUBLE)::BIGINT AS longest FROM item),
        spans AS (
          SELECT p.doc_seq, k, {_normal("t")} AS goal, p.text, o.start_pos AS s, unnest(range(o.start_pos + shortest, least(o.start_pos + longest, length(p.text)) + 1)) AS e
          FROM plain p JOIN token o ON o.doc_seq = p.doc_seq WHERE len(exact) = 0 AND ci < 0),
        win AS (SELECT doc_seq, k, goal, s, e, {_normal("substr(text, s + 1, e - s)")} AS w FROM spans),
        pairs AS (SELECT DISTINCT goal AS a, w AS b FROM win WHERE 2.0::DOUBLE * least(length(goal), length(w)) / (length(goal) + length(w)) >= {threshold}::DOUBLE),
        {_SIMILAR},
        near AS (SELECT doc_seq, k, list({{'s': s::BIGINT, 'e': e::BIGINT}} ORDER BY r DESC, s, e) AS p FROM win JOIN matched ON goal = a AND w = b WHERE r >= {threshold}::DOUBLE GROUP BY doc_seq, k),
        places AS (
          SELECT x.doc_seq, x.k, t, CASE WHEN len(exact) > 0 OR ci >= 0 THEN 'exact' ELSE 'fuzzy' END AS st,
                 CASE WHEN len(exact) > 0 THEN list_transform(exact, lambda i: {{'s': i, 'e': i + length(t)}}) WHEN ci >= 0 THEN [{{'s': ci, 'e': ci + length(t)}}] ELSE coalesce(near.p, []) END AS p
          FROM plain x LEFT JOIN near ON near.doc_seq = x.doc_seq AND near.k = x.k),
        folded AS (
          SELECT doc_seq, list(t ORDER BY k) AS t, list_reduce(list({{'p': p, 'st': st, 'taken': []::STRUCT(s BIGINT, e BIGINT)[], 'out': []::STRUCT(s BIGINT, e BIGINT, st VARCHAR)[]}} ORDER BY k), lambda acc, x:
            {{'p': x.p, 'st': x.st,
             'taken': CASE WHEN len(list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i.e AND i.s < o.e)) = 0)) > 0
               THEN list_append(acc.taken, list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i.e AND i.s < o.e)) = 0)[1]) ELSE acc.taken END,
             'out': list_append(acc.out, CASE WHEN len(x.p) = 0 THEN {{'s': NULL::BIGINT, 'e': NULL::BIGINT, 'st': 'ungrounded'}}
               WHEN len(list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i.e AND i.s < o.e)) = 0)) > 0
               THEN {{'s': list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i.e AND i.s < o.e)) = 0)[1].s,
                      'e': list_filter(x.p, lambda i: len(list_filter(acc.taken, lambda o: o.s < i.e AND i.s < o.e)) = 0)[1].e, 'st': x.st}}
               ELSE {{'s': x.p[1].s, 'e': x.p[1].e, 'st': 'overlap'}} END)}},
            {{'p': []::STRUCT(s BIGINT, e BIGINT)[], 'st': '', 'taken': []::STRUCT(s BIGINT, e BIGINT)[], 'out': []::STRUCT(s BIGINT, e BIGINT, st VARCHAR)[]}}).out AS l FROM places GROUP BY doc_seq)"""

_FOLDED = "SELECT doc_seq, (generate_subscripts(l, 1) - 1)::INT AS extraction_index, unnest(t) AS text, unnest(l).st AS alignment_status, unnest(l).s::INT AS start_pos, unnest(l).e::INT AS end_pos FROM folded"

_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

_EMAILS = rf"""
        WITH m AS (
          SELECT doc_id AS doc_seq, unnest(regexp_extract_all(text, '(?s)(.*?)({EMAIL})', 1)) AS gap, unnest(regexp_extract_all(text, '(?s)(.*?)({EMAIL})', 2)) AS text,
                 generate_subscripts(regexp_extract_all(text, '(?s)(.*?)({EMAIL})', 2), 1) AS i FROM documents),
        o AS (SELECT *, sum(length(gap) + length(text)) OVER (PARTITION BY doc_seq ORDER BY i) AS e FROM m)
        SELECT doc_seq, 'email' AS extraction_class, text, 'exact' AS alignment_status, (e - length(text))::INT AS start_pos, e::INT AS end_pos FROM o"""

ORACLE_SQL: dict[str, str] = {
    "tokens_ws": _token_sql(tokens.NON_SPACE),
    "tokens_unicode": _token_sql(_U),
    "tokens_unicode_native": _token_sql(_U),
    "token_counts_by_lang": f"SELECT lang, count(*) AS n_docs, sum(len(regexp_extract_all(text, '{_U}')))::BIGINT AS n_tokens FROM documents GROUP BY lang",
    "sentences": f"WITH {_SENTENCES} SELECT doc_seq, (row_number() OVER (PARTITION BY doc_seq ORDER BY i) - 1)::INT AS \"index\", s::INT AS start_pos, e::INT AS end_pos FROM sent",
    "sentences_native": f"WITH {_SENTENCES} SELECT doc_seq, (row_number() OVER (PARTITION BY doc_seq ORDER BY i) - 1)::INT AS \"index\", s::INT AS start_pos, e::INT AS end_pos FROM sent",
    "chunks_2000": _chunk_rows(2000),
    "chunks_200": _chunk_rows(200),
    "chunk_token_spans": f"""WITH RECURSIVE {_chunk_sql(2000)}, token AS ({_token_sql(_U)})
        SELECT c.doc_seq, c.chunk_index, min(t."index")::INT AS tok_start, (max(t."index") + 1)::INT AS tok_end
        FROM chunk c LEFT JOIN token t ON t.doc_seq = c.doc_seq AND t.start_pos < c.end_pos AND c.start_pos < t.end_pos GROUP BY ALL""",
    "prompt_context": f"""WITH RECURSIVE {_chunk_sql(2000)}
        SELECT doc_seq, chunk_index, pass_index::INT AS pass_index, concat_ws(chr(10) || chr(10), 'Task: {TASK}', 'Additional context: Invented prose',
          'Extraction pass: ' || (pass_index + 1) || ' of 2. Return grounded extractions for this pass.',
          'Context before:' || chr(10) || substr(text, greatest(start_pos - {WINDOW}, 0) + 1, start_pos - greatest(start_pos - {WINDOW}, 0)), 'Context after:' || chr(10) || substr(text, end_pos + 1, {WINDOW}),
          'Text:' || chr(10) || substr(text, start_pos + 1, end_pos - start_pos), '{_quoted(prompts.CONTRACT)}') AS prompt
        FROM chunk JOIN documents ON doc_id = doc_seq, range(0, 2) AS p(pass_index)""",
    "prompt_examples": f"""WITH RECURSIVE {_chunk_sql(2000)}
        SELECT doc_seq, chunk_index, concat_ws(chr(10) || chr(10), 'Task: {TASK}', '{_quoted(prompts.examples_section(list(EXAMPLES)))}',
          'Text:' || chr(10) || substr(text, start_pos + 1, end_pos - start_pos), '{_quoted(prompts.CONTRACT)}') AS prompt FROM chunk JOIN documents ON doc_id = doc_seq""",
    "example_issues": f"""WITH w AS (SELECT conv_id, turn, text, regexp_extract(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[^{WS}]+') AS wanted FROM conversations)
        SELECT conv_id, turn, CASE WHEN NOT regexp_matches(wanted, '[^{WS}\\x00]') THEN 'text is empty' WHEN strpos(text, wanted) = 0 THEN 'text is not present in example text' END AS issue FROM w""",
    "fenced_payloads": f"""WITH {_OUTPUTS}, b AS (SELECT doc_id, regexp_extract_all(o, '(?is)```(?:json|yaml|yml)?[{WS}]*(.*?)```', 1) AS l FROM out)
        SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS block, rtrim(unnest(l), chr(10) || ' ') AS payload FROM b""",
    "parse_json_items": """
        SELECT doc_id, 0 AS item_index, CASE WHEN quality = 1 THEN 'good' END AS extraction_class, 'q' || quality AS text, NULL::VARCHAR AS description, '{"doc": ' || doc_id || '}' AS attributes_json, NULL::VARCHAR AS group_id FROM labels
        UNION ALL SELECT doc_id, 1, 'toxic', 't' || toxic, NULL, '{}', NULL FROM labels""",
    "json_items_native": """
        SELECT doc_id, 0 AS item_index, CASE WHEN quality = 1 THEN 'good' END AS extraction_class, 'q' || quality AS text FROM labels
        UNION ALL SELECT doc_id, 2, 'toxic', 't' || toxic FROM labels""",
    "parse_forms": f"""
        WITH one AS (SELECT *, doc_id % {len(FORMS)} AS form FROM labels),
        item AS (SELECT doc_id, form, unnest(CASE WHEN form = 3 THEN [0, 1] WHEN form < 3 THEN [0] ELSE [] END) AS i, quality, toxic FROM one)
        SELECT doc_id, i::INT AS item_index, 'k' || doc_id AS extraction_class, 'q' || quality AS text, 'd' AS description, '{{"x": true}}' AS attributes_json, toxic::VARCHAR AS group_id FROM item
        UNION ALL SELECT doc_id, 0, 'k' || doc_id, 't' || doc_id, NULL, '{{"n": ' || doc_id || '}}', NULL FROM one WHERE form = 7
        UNION ALL SELECT doc_id, 0, NULL, doc_id::VARCHAR, NULL, '{{}}', NULL FROM one WHERE form = 8
        UNION ALL SELECT doc_id, 0, NULL, 'second ' || doc_id, NULL, '{{}}', NULL FROM one WHERE form = 9""",
    "parse_failures": f"""
        SELECT doc_id, CASE WHEN doc_id % {len(FORMS)} = 3 THEN 2 WHEN doc_id % {len(FORMS)} IN (4, 5, 6) THEN 0 ELSE 1 END AS n_items, doc_id % {len(FORMS)} IN (4, 5) AS failed FROM labels""",
    "schema_types": "SELECT doc_id, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS n_items, CASE WHEN quality <> 1 THEN 'schema validation failed: extraction 1 group_id must be string' END AS parse_error FROM labels",
    "schema_violations": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS n_items, CASE WHEN quality <> 1 THEN 'schema validation failed: extraction 0 missing extraction_class' END AS parse_error FROM labels""",
    "exact_all_occurrences": f"""
        SELECT doc_id AS doc_seq, target, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(target)) = target))::INT AS start_pos
        FROM documents, (SELECT unnest({list(LOOKED_FOR)!r}) AS target)""",
    "exact_first_ci": f"SELECT doc_id AS doc_seq, target, (strpos(lower(text), lower(target)) - 1)::INT AS start_pos FROM documents, (SELECT unnest({list(LOOKED_FOR)!r}) AS target)",
    "token_intervals": f"""WITH {_ALIGNED}, token AS ({_token_sql(_U)})
        SELECT a.doc_seq, a.extraction_index, min(t."index")::INT AS tok_start, (max(t."index") + 1)::INT AS tok_end
        FROM aligned a LEFT JOIN token t ON t.doc_seq = a.doc_seq AND t.start_pos < a.start_pos + length(a.text) AND a.start_pos < t.end_pos GROUP BY a.doc_seq, a.extraction_index""",
    "fuzzy_parts": f"WITH RECURSIVE {_PARTS}, {_fuzzy(_U, alignment.THRESHOLD)} {_FOLDED}",
    "fuzzy_parts_ws": f"WITH RECURSIVE {_PARTS}, {_fuzzy(tokens.NON_SPACE, 0.7)} {_FOLDED}",
    "similarity_pairs": f"""WITH RECURSIVE names AS (SELECT p_partkey, p_name AS a, translate(p_name, 'aeioulr', 'eiouarl') || ' ' || lower(p_type) AS b FROM part),
        pairs AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM names UNION ALL SELECT b, a FROM names)), {_SIMILAR}
        SELECT p_partkey, x.r AS forth, y.r AS back FROM names n JOIN matched x ON x.a = n.a AND x.b = n.b JOIN matched y ON y.a = n.b AND y.b = n.a""",
    "overlap_status": f"WITH {_ALIGNED} SELECT doc_seq, extraction_index, text, alignment_status, start_pos, (start_pos + length(text))::INT AS end_pos FROM aligned",
    "annotate_counts_by_status": f"WITH {_ALIGNED} SELECT alignment_status, count(*) AS n FROM aligned GROUP BY alignment_status",
    "merge_distinct": f"WITH {_SPANS}, {_FIRST} SELECT * FROM firsts",
    "merge_greedy": f"WITH {_SPANS}, {_FIRST}, {_greedy('firsts')} SELECT doc_seq, unnest(l).seq AS seq, unnest(l).s AS start_pos, unnest(l).e AS end_pos FROM kept",
    "merge_regroup": f"WITH {_SPANS}, {_greedy('spans')} SELECT c_custkey::BIGINT AS doc_seq, coalesce(len(l), 0)::BIGINT AS n FROM customer LEFT JOIN kept ON c_custkey = doc_seq",
    "extract_regex_model": _EMAILS,
    "extract_by_adapter": _EMAILS,
    "source_values": """
        SELECT -1::BIGINT AS doc_seq, 'document_0' AS id, 'only text' AS text, '{}' AS metadata_json UNION ALL SELECT 0, 'a', 'one text', '{"k": 1}' UNION ALL SELECT 1, NULL, 'no id', '{}'
        UNION ALL SELECT 2, 'document_2', 'a plain text', '{}' UNION ALL SELECT 3, 'document_3', '7', '{}'""",
    "page": f"""
        WITH s AS (SELECT string_agg('<section>' || chr(10) || '<h1>' || r_regionkey || '</h1>' || chr(10) || '<pre><mark data-status="exact">' || substr(r_name, 1, 3) || '<span class="label">extraction</span></mark>'
                    || substr(r_name, 4) || '</pre>' || chr(10) || '</section>' || chr(10), '' ORDER BY r_regionkey) AS body FROM region),
        l AS (SELECT string_split('{_quoted(html.HEAD)}' || body || '{_quoted(html.TAIL)}', chr(10)) AS x FROM s)
        SELECT (generate_subscripts(x, 1) - 1)::INT AS line, unnest(x) AS html FROM l""",
    "extract_lenient": "SELECT doc_id AS doc_seq, 0::BIGINT AS n_extractions, 2::BIGINT AS n_runs FROM documents",
    "render_clashing_marks": f"""
        WITH {_PARTS}, p AS (SELECT *, strpos(text, ' of ') AS a, strpos(text, p_brand) AS b FROM documents)
        SELECT doc_id AS doc_seq, '<section>' || chr(10) || '<h1>' || doc_id || '</h1>' || chr(10) || '<pre>' || {_ESCAPED.format("substr(text, 1, a - 1)")}
          || '<mark data-status="exact"> of <span class="label">a&amp;b</span></mark>' || {_ESCAPED.format("substr(text, a + 4, b - a - 4)")}
          || '<mark data-status="exact">' || {_ESCAPED.format("p_brand")} || '<span class="label">brand</span></mark>' || {_ESCAPED.format("substr(text, b + length(p_brand))")}
          || '</pre>' || chr(10) || '</section>' || chr(10) AS html FROM p""",
    "render_marks": f"""
        WITH p AS (SELECT doc_id, text, CASE WHEN strpos(text, 'the') > 0 THEN strpos(text, 'the') ELSE strpos(lower(text), 'the') END AS a FROM documents)
        SELECT doc_id AS doc_seq, '<section>' || chr(10) || '<h1>' || doc_id || '</h1>' || chr(10) || '<pre>' || CASE WHEN a > 0
          THEN {_ESCAPED.format("substr(text, 1, a - 1)")} || '<mark data-status="exact">' || {_ESCAPED.format("substr(text, a, 3)")} || '<span class="label">extraction</span></mark>' || {_ESCAPED.format("substr(text, a + 3)")}
          ELSE {_ESCAPED.format("text")} END || '</pre>' || chr(10) || '</section>' || chr(10) AS html FROM p""",
}
