"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from qualframe.llm import bytebpe, hostrules, probminhash, queries, sql, toxicity, winnow

SMALL = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")


def test_queries_match_their_sql(spark):
    assert compare(spark, SMALL, list(sql.ORACLE_SQL)) == 0


def test_one_query_for_each_operator():
    found = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline_is_its_operators_one_after_the_other(spark):
    docs = queries.table(spark, SMALL, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = {r.row.doc_id for r in hostrules.quality_rules(docs).filter("kept").collect()}
    docs = docs.filter(docs.doc_id.isin(list(kept)))
    model = queries.toxicity_model(spark, docs, SMALL)
    scored = toxicity.score_documents(docs, model, ["doc_id", "lang"])
    kept = ids(scored.filter(scored.score < toxicity.threshold_of(model)))
    docs = docs.filter(docs.doc_id.isin(list(kept)))
    docs = docs.filter(docs.doc_id.isin(list(ids(probminhash.near_duplicates(docs).filter("kept")))))
    clean = winnow.overlaps(docs, queries.table(spark, SMALL, "benchmark")).filter("n_hit = 0")
    docs = docs.filter(docs.doc_id.isin([r.doc for r in clean.collect()]))
    want = {r.doc_id: r.ids_sha256 for r in bytebpe.encode_documents(docs, queries.multi_tokenizer()).collect()}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SMALL, "documents").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_native_operators_run_no_python(spark):
    for name in ("op1_chat_format", "op4_winnowing", "op7_bounded_ring", "op10_host_rules"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
