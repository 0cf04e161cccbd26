"""The pipeline against its stages' brute-force rules, and the SQL of the queries."""

import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL, plain
from tests.llm.cases import frame
from tickloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF_SMALL).toPandas()) == plain(duck.sql(queries.SQL[name]).df())


def test_stages_keep_columns_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        now = {r.doc_id: r.text for r in out.collect()}
        assert now.keys() <= ids
        if name != "line_dedup":
            assert all(texts[i] == t for i, t in now.items())
        else:
            assert now.keys() == texts.keys()
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids, texts = set(now), now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r.doc_id for r in last.collect()} == ids
    whole = corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.select(*whole.columns).collect()))


def test_stages_on_awkward_documents(spark):
    for docs in (frame(spark), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_SMALL).count()


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
