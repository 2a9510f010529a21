"""The pipeline's stages against their operators and brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF001, SF01
from tests.llm.test_tokens import check_packing
from tunesmith.llm import catalog, simhash, toxicity
from tunesmith.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF01), name)
        out.append((name, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    assert all(df.columns == COLUMNS for _, df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages[0][1], {r.doc_id for r in stages[1][1].select("doc_id").collect()}
    scored = toxicity.score(before, catalog.toxicity_model(spark, before, SF01)).collect()
    assert after == {r.doc_id for r in scored if r.score < catalog.TOXICITY_BAR}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean - after) <= 0.01 * len(clean)


def test_language_keeps_clean_documents(stages):
    assert stages[2][1].count() == stages[1][1].count()


def test_lines_only_shrink_texts(stages):
    before = {r.doc_id: r.text for r in stages[2][1].collect()}
    after = {r.doc_id: r for r in stages[3][1].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        rest = iter(before[i].split("\n"))
        assert r.text == "" or all(line in rest for line in r.text.split("\n"))  # a subsequence of its lines
        assert r.n_chars == len(r.text)
    kept = [line.strip().lower() for r in after.values() for line in r.text.split("\n") if any(c.isalnum() for c in line)]
    assert len(kept) == len(set(kept))


def test_one_document_of_each_group_stays(stages):
    groups = simhash.near_duplicates(stages[3][1]).groupBy("component_id").count().collect()
    assert sorted(r.doc_id for r in stages[4][1].collect()) == sorted(r.component_id for r in groups)


def test_packing_covers_what_is_left(stages):
    check_packing(stages[5][1].collect(), [(r.doc_id, r.text) for r in stages[4][1].collect()])


def test_edge_rows_and_empty_table(spark, edge, empty):
    for docs in (edge.drop("id"), empty.drop("id"), edge):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = materialize(stage(spark, docs, SF001), "edge")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF01)
    assert got.columns == stages[5][1].columns
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[5][1].select(key).collect()))
