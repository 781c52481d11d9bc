"""The pipeline against brute force, stage by stage, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from hazardlens.llm import decision_list, mixing, queries
from tests.llm import reference
from tests.llm.test_pairs import expected_lines
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path, spark, documents):
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    text = documents.where("doc_id = 20").first()["text"]
    spark.createDataFrame([(1, " ".join(text.split()[:30])), (2, "w1 w2")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_is_the_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = decision_list.fit_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["c0"] for r in decision_list.judged(docs, ["doc_id"], rules).where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    rows = [(i, after) for (i, text), after in zip(rows, expected_lines(rows).values(), strict=True)
            if after == text or reference.words(after)]
    groups = reference.jaccard(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not reference.contamination(t, items)[1]]
    mix = corpus_pipeline.run(spark, folder)
    assert mix.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    left = spark.createDataFrame([(i, t, source[i]) for i, t in rows], "doc_id bigint, text string, source string")
    want = Counter({r["doc_id"]: r["mix_copies"] for r in mixing.with_copies(left).where("mix_copies > 0").collect()})
    got = mix.collect()
    assert Counter(r["doc_id"] for r in got) == want and sum(want.values()) > 20
    assert all(r["text"] == dict(rows)[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_stages_stand_empty_and_odd_tables(spark, folder, odd_rows, nothing):
    for docs in (odd_rows, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), folder)
            assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert out.count() <= 2 * docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, FOLDER, [name], show=lambda *_: None) == []


def test_stage_names_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join",
                                                      "benchmark decontamination", "mixing sources to target weights"]
