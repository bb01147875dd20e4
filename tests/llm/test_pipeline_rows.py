"""The pipeline over odd rows: nulls, repeats, clashing columns, no rows; each stage against brute force on what the one before kept."""

from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from groundline.llm import mixing, quality_classifier
from groundline.llm.common import cut, documents

from .test_operators import CLASHING, SCHEMA, five_word_components, lines_brute, odd_rows, order, sha

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    rows = [r for r in odd_rows() if not (r[1] or "").startswith("aaa")]
    junk = [(900 + k, "!!! $$$ buy ### now " * (20 + k % 4), "s9") for k in range(16)]
    columns = [c for c in CLASHING if c != "text"]
    spark.createDataFrame([(i, t, s, None, None, *["x"] * len(columns)) for i, t, s in rows + junk], SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 900), 0) for i in {r[0] for r in rows + junk if r[0] is not None}] + [(None, 1, 0), (5, None, 0)], LABELS).write.parquet(f"{out}/labels.parquet")
    return out


def named(rows):
    return Counter((r.doc_id, r.text or "") for r in rows)


def test_stages_over_odd_rows(spark, folder):
    import public_tokenizers

    docs = documents(spark, folder)
    labels = documents(spark, folder, "labels")
    columns = docs.columns
    model = quality_classifier.train(docs, labels)
    kept = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder))
        assert name == "packing" or docs.columns == columns
        kept[name] = docs.collect()
    score = dict(zip([r.text or "" for r in kept["start"]], quality_classifier.scores(model, [(r.text or "").encode() for r in kept["start"]]), strict=True))
    assert named(kept["quality classifier"]) == Counter({k: n for k, n in named(kept["start"]).items() if score[k[1]] >= 0.5})
    assert len(kept["quality classifier"]) < len(kept["start"])
    assert Counter((r.doc_id, sha(r.text or "")) for r in kept["line dedup"]) == Counter((i, s) for i, _, _, s, _ in lines_brute([(r.doc_id, r.text) for r in kept["quality classifier"]]))
    lined = [(r.doc_id, r.text) for r in kept["line dedup"]]
    label, groups = five_word_components(lined), defaultdict(list)
    for k, (i, t) in enumerate(lined):
        groups[label[k]].append((order(i), t or ""))
    stays = named(kept["near duplicates"])
    assert sum(stays.values()) == len(groups)
    for g in groups.values():  # one row of each group, of its smallest doc_id
        own = [(i, t) for i, t in g if (None if i == order(None) else i, t) in stays]
        assert own and min(g)[0] == own[0][0]
    taken = Counter()
    for r in mixing.mix(spark.createDataFrame(kept["near duplicates"], documents(spark, folder).schema)).collect():
        taken[r.doc_id, r.th] += r.times
    assert sum(taken.values()) == len(kept["source mix"])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept["source mix"]:
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, windows = Counter(), Counter()
    for r in kept["packing"]:
        got[r.doc_id] += r.length
        windows[r.sequence_id] += r.length
    assert got == want and max(windows.values()) <= 2048


def test_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
