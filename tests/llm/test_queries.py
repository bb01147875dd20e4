"""The queries against their SQL, and the pipeline's stages against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from groundline.llm import mixing, queries
from groundline.llm.common import cut, documents

from .test_operators import five_word_components, lines_brute, sha

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, agree, name):
    agree(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    # the classifier rejects, and no document that is labelled good
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    accepted = {r.doc_id for r in rows["quality classifier"]}
    assert good <= accepted and len(accepted) < 200
    # lines
    before = [(r.doc_id, r.text) for r in rows["quality classifier"]]
    assert Counter((r.doc_id, sha(r.text or "")) for r in rows["line dedup"]) == Counter((i, s) for i, _, _, s, _ in lines_brute(before))
    assert all(r.n_chars == len(r.text) for r in rows["line dedup"])
    # one document of each group of texts that share 0.8 of their five-word shingles
    lined = sorted((r.doc_id, r.text) for r in rows["line dedup"])
    label = five_word_components(lined)
    assert sorted(r.doc_id for r in rows["near duplicates"]) == [i for k, (i, _) in enumerate(lined) if label[k] == k]
    # the mix, as often as it takes each document
    kept = spark.createDataFrame(rows["near duplicates"], documents(spark, SF).schema)
    times = {r.doc_id: r.times for r in mixing.mix(kept).collect()}
    assert Counter(r.doc_id for r in rows["source mix"]) == Counter({i: n for i, n in times.items() if n})
    # packing: every id of every copy in one place
    tokens, windows = defaultdict(int), defaultdict(int)
    for r in rows["packing"]:
        tokens[r.doc_id] += r.length
        windows[r.sequence_id] += r.length
    sizes = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    assert tokens == {i: sizes[i] * n for i, n in Counter(r.doc_id for r in rows["source mix"]).items()}
    assert max(windows.values()) <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_near_duplicates_share_no_five_word_shingles(spark):
    docs = cut(corpus_pipeline.lines(spark, documents(spark, SF), SF))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label = five_word_components(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [i for k, (i, _) in enumerate(rows) if label[k] == k]
