"""Every query runs on the smallest tables and, where SQL can express it, equals its twin."""

import duckdb
import pytest

import __spark_entry__ as entry
from sensorloom.llm.catalog import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()


def test_registered():
    assert len(QUERIES) == 13 and set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        want = con.sql(SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns) and len(got) == len(want)
        a, b = (d[cols].astype("object").where(d[cols].notna(), -1).sort_values(cols).reset_index(drop=True) for d in (got, want))
        assert (a == b).all().all()


def test_held_out_scores(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    for name, label, least in (("op10_quality_model", "quality", 0.9), ("op5_toxicity", "toxic", 0.9)):
        got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas().merge(known, on="doc_id").dropna()
        assert (got.predicted == got[label]).mean() > least, name


def test_pipeline(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in pipe.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns
        kept = out.cache()
    rows = pipe.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(r.length for r in rows) >= kept.count()
