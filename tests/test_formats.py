"""Parsing, prompts, models and settings."""

import io

import pytest

import groundline as g
from groundline.operators import models, parsing, prompts
from pyspark.sql import functions as F


def test_fenced_json():
    got = g.parse('Here:\n```JSON\n{"extractions":[{"text":"Alice","class":"person","attributes":{"age":30}}]}\n```\nbye')
    assert got == [{"extraction_class": "person", "text": "Alice", "description": None, "attributes": {"age": 30}, "group_id": None}]


def test_yaml():
    assert g.parse("extractions:\n  - text: $94.8 billion\n    class: :money", "yaml")[0] == {"extraction_class": "money", "text": "$94.8 billion", "description": None, "attributes": {}, "group_id": None}


@pytest.mark.parametrize("output", ["not json", "```json\nnope: [\n```", '"text"', "3", '[{"text": null}]', "[1]", '[{"text": "a"}, {}]', '[{"text": "a", "attributes": [1]}]'])
def test_strict_and_lenient(output):
    with pytest.raises(g.FormatParsingError):
        g.parse(output)
    assert g.parse(output, strict=False) == []


@pytest.mark.parametrize(
    ("output", "fmt", "texts"),
    [
        ("", "auto", []), ("null", "json", []), ("false", "json", []), ('{"extractions": null, "text": "x"}', "json", ["x"]), ('{"extractions": [], "data": [{"text": "y"}]}', "json", []),
        ('{"data": [{"text": "y"}]}', "json", ["y"]), ('{"items": [{"extraction_text": 5}, null]}', "json", ["5"]), ('[{"text": true}]', "json", ["true"]), ('{"text": "one"}', "json", ["one"]),
        ("```\n\n```\n{}", "auto", None), ("```yaml\n- text: a\n```\n```json\n[{\"text\": \"b\"}]\n```", "json", ["b"]),
    ],
)
def test_payloads(output, fmt, texts):
    if texts is None:
        with pytest.raises(g.FormatParsingError):
            g.parse(output, fmt)
    else:
        assert [x["text"] for x in g.parse(output, fmt)] == texts


@pytest.mark.parametrize(("output", "fmt"), [("", "json"), ("NaN", "json"), ("[" * 101 + "]" * 101, "json"), ("- text: 2024-01-01", "yaml"), ("a: &x 1\nb: *x", "yaml"), ("[]", "xml")])
def test_refused(output, fmt):
    with pytest.raises(g.FormatParsingError):
        g.parse(output, fmt)


def test_schema():
    schema = {"required": ["extraction_class"], "properties": {"text": {"type": "string"}, "attributes": {"type": "object"}, "description": {"type": "number"}, "group_id": {"type": "unknown"}}}
    assert g.parse('[{"text": "a", "class": "c", "description": 2, "group_id": 1}]', schema=schema)
    with pytest.raises(g.FormatParsingError, match="missing extraction_class"):
        g.parse('[{"text": "a"}]', schema=schema)
    with pytest.raises(g.FormatParsingError, match="description must be number"):
        g.parse('[{"text": "a", "class": "c", "description": "x"}]', schema=schema)


def test_parsed_rows(spark):
    df = spark.createDataFrame([(1, '[{"text": "a"}]'), (2, "nope"), (3, "")], "k long, output_text string")
    got = {r.k: r for r in g.parsed(df).collect()}
    assert got[1]["items"][0].text == "a" and got[1].parse_error is None
    assert got[2]["items"] == [] and "unable to parse" in got[2].parse_error
    assert got[3]["items"] == [] and got[3].parse_error is None


def test_native_json_items(spark):
    outputs = ['{"extractions":[{"text":"a","class":"c"}]}', '[{"text":"b"}]', '{"text":"c"}', '{"data":[{"extraction_text":"d"}]}', '{"extractions":[]}']
    got = spark.createDataFrame(enumerate(outputs), "k long, o string").select("k", parsing.json_items(F.col("o")).alias("x")).orderBy("k").collect()
    assert [[(x.extraction_class, x.text) for x in r.x] for r in got] == [[("c", "a")], [(None, "b")], [(None, "c")], [(None, "d")], []]


def test_prompt():
    example = g.Example("Microsoft reported profit.", [{"text": "Microsoft", "extraction_class": "company"}])
    text = prompts.assembled("Extract companies", "Apple reported revenue.", examples=prompts.examples_section([example]), additional_context="Financial filings", before="Before. ", after=" After.", window=8, pass_index=0, total_passes=2)
    assert text.split("\n\n")[:3] == ["Task: Extract companies", "Additional context: Financial filings", "Extraction pass: 1 of 2. Return grounded extractions for this pass."]
    assert "Context before:\nBefore. \n\nContext after:\n After." in text and '"text": "Microsoft"' in text and text.endswith(prompts.CONTRACT)
    assert models.chunk_text(text) == "Apple reported revenue."


def test_prompt_columns_are_the_kernels(spark):
    docs = g.from_values(spark, ["One sentence. Another one follows. Third.", "Short."])
    parts = g.chunked(docs, 18)
    options = {"additional_context": "", "context_window_chars": 5, "passes": 2, "examples": [{"text": "a b", "extractions": [{"text": "a"}]}]}
    got = {(r.doc_seq, r.chunk_index, r.pass_index): r.prompt for r in prompts.prompts(parts, docs, "T", **options).collect()}
    unjoined = prompts.prompts(g.chunked(docs, 18, context_window_chars=5), None, "T", **options)
    assert {(r.doc_seq, r.chunk_index, r.pass_index): r.prompt for r in unjoined.collect()} == got
    assert "Exchange" not in unjoined._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_seq: r.text for r in docs.collect()}
    for r in parts.collect():
        for k in range(2):
            t = texts[r.doc_seq]
            want = prompts.assembled("T", r.text, examples=prompts.examples_section([{"text": "a b", "extractions": [{"text": "a"}]}]), additional_context="", before=t[max(0, r.start_pos - 5) : r.start_pos], after=t[r.end_pos : r.end_pos + 5], window=5, pass_index=k, total_passes=2)
            assert got[r.doc_seq, r.chunk_index, k] == want


def test_example_validation():
    bad = [{"text": "Patient text", "extractions": [{"text": "Missing"}]}, {"text": " ", "extractions": []}, {"text": "x", "extractions": [{"text": "  "}]}]
    assert prompts.issues(bad) == ["example 0 extraction 0 text is not present in example text", "example 1 text is empty", "example 1 has no extractions", "example 2 extraction 0 text is empty"]
    prompts.validate(bad, "off")
    out = io.StringIO()
    prompts.validate(bad, "warning", out)
    assert "failed validation" in out.getvalue()
    with pytest.raises(g.PromptValidationError, match="not present"):
        prompts.validate(bad, "error")
    with pytest.raises(ValueError):
        prompts.validate([], "loud")


class Echo(g.Provider):
    def infer(self, prompt):
        return models.InferenceResult(prompt)


def test_router():
    g.router().register("echo", Echo)
    model = g.create_model(g.ModelConfig(adapter="echo", model="m"))
    assert isinstance(model, Echo) and models.call(model, "hi") == "hi" and g.router().names == ["chat", "echo"]
    g.reset_configuration()
    with pytest.raises(g.InvalidModelConfigError):
        g.create_model(g.ModelConfig(adapter="echo", model="m"))


def test_settings():
    g.configure(default_model="configured")
    config = g.ModelConfig()
    assert config.model == "configured" and config.provider is None and "api_key" not in config.to_dict()
    g.configure(lambda c: setattr(c, "default_model", "other"))
    assert g.config().default_model == "other"
    g.reset_configuration()
    with pytest.raises(AttributeError):
        g.configure(nonsense=1)
    for bad in ({"adapter": ""}, {"provider": ""}, {"model": ""}):
        with pytest.raises(g.InvalidModelConfigError):
            g.ModelConfig(**bad)


def test_chat_adapter():
    class Answer:
        content = "hello"

    asked = []
    model = g.create_model(g.ModelConfig(model="m", options={"client": lambda prompt, **kw: asked.append((prompt, kw)) or Answer(), "temperature": 0}))
    assert models.call(model, "p") == "hello" and asked == [("p", {"model": "m", "provider": None, "temperature": 0})]
    assert g.create_model(g.ModelConfig(options={"client": "builtins:repr"})).config.options["client"] == "builtins:repr"
    named = g.create_model(g.ModelConfig(model="m", provider="p", options={"client": "types:SimpleNamespace.__call__"}))
    with pytest.raises(g.ProviderConfigError):
        named.infer("p")  # no such callable: found out where the model is asked
    with pytest.raises(g.ProviderConfigError):
        g.create_model(g.ModelConfig(options={"client": "no_such_module:x"})).infer("p")
    assert g.create_model(g.ModelConfig(model="m", provider="p", options={"client": "tests.test_formats:echo"})).infer("hi").text == "hi m p"
    for client in (None, lambda prompt, **kw: 1 / 0):
        with pytest.raises(g.ProviderConfigError):
            g.create_model(g.ModelConfig(options={"client": client} if client else {})).infer("p")


def test_models_must_infer():
    with pytest.raises(g.InvalidModelConfigError):
        models.checked(object())
    with pytest.raises(TypeError):
        g.Provider(g.ModelConfig())
    assert models.call(g.ReplayModel({"p": "q"}), "p") == "q"
    with pytest.raises(g.ProviderConfigError):
        g.ReplayModel({}).infer("p")


def echo(prompt, model, provider):
    return f"{prompt} {model} {provider}"
