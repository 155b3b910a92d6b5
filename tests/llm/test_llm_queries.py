"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from notecode.llm.oracle import LLM_ORACLE
from notecode.llm.queries import LLM_QUERIES

FOLDER = registered.SMOKE_DIR


def shown(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def test_all_are_registered():
    assert set(LLM_QUERIES) <= set(registered.queries())
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {name.split("_")[0] for name in LLM_QUERIES}


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        database.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    expected = database.sql(LLM_ORACLE[name])
    result = LLM_QUERIES[name](spark, FOLDER)
    assert sorted(result.columns) == sorted(expected.columns)
    rows = sorted(tuple(shown(v) for v in row) for row in result.select(expected.columns).collect())
    assert rows == sorted(tuple(shown(v) for v in row) for row in expected.fetchall())


def test_stages_return_documents(spark):
    rows = [
        (1, "the river and the house are near the old mill today", "en", "a", 50, "x"),
        (2, "the river and the house are near the old mill today", "en", "b", 50, "x"),
        (3, "write to me@site.org about the house and the mill", "en", "a", 49, "x"),
        (4, None, None, None, None, None),
        (5, "12 34 !!", "en", "b", 8, "x"),
        (6, "", "en", "b", 0, "x"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string"
    docs = spark.createDataFrame(rows * 2, schema)
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], ({1, 2, 3}, {1, 3}, {1, 3}, {1, 3})):
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == schema.replace(",", "").split()[::2]
        assert {r.doc_id for r in docs.collect()} == ids
    assert {r.text for r in docs.collect()} == {rows[0][1], rows[2][1].replace("me@site.org", "[EMAIL]")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_each_document_stays_once(spark):
    mill, hill = "the river and the house are near the old mill today", "a wholly different text about hills and what lies behind"
    rows = [(1, mill), (1, mill), (1, mill), (2, mill), (2, hill), (3, hill), (None, mill), (None, mill), (None, None), (None, None), (4, None), (4, "short")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    # By hand: one row per id with its least text, then the least id of equal texts.
    assert sorted(kept, key=str) == sorted([(1, mill), (2, hill), (4, "short"), (None, mill), (None, None)], key=str)
