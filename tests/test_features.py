"""Lengths, distinct terms and vectors of texts, measured where the texts lie."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import features

duckdb = pytest.importorskip("duckdb")
ROWS = [(1, "Red wine, red wines; running run ran"), (1, "wine and red cars"), (2, None), (3, "the 12 a"), (4, "only " * 500 + "one"), (None, "first part"), (None, "second part")]


@pytest.mark.parametrize("name", ["doc_len", "vectorize"])
def test_repeated_ids_are_one_document(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(features, "CHUNK", 5)
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    whole = lambda rows: sorted((tuple(round(float(x), 5) if x is not None else -1 for x in r) for r in rows))
    assert whole(tuple(r) for r in got.select(*names).collect()) == whole(want.fetchall())


def test_nothing_is_dealt_out(spark):
    df = spark.createDataFrame(ROWS[:1] + ROWS[2:5], "doc_id long, text string")
    assert features.measured(features.whole_texts(df, "doc_id", "text"), "doc_id", F.col("text"), vectors=True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0


def test_what_is_kept_is_a_compressed_table(spark, tmp_path, monkeypatch):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        vectors = features.featured(spark.createDataFrame([(i, f"red wine {i}") for i in range(300)], "id long, text string"), ["id"], {"text": F.col("text")})
        kept = features.kept(vectors)
        assert sorted(map(tuple, kept.select("id", "text_terms").collect())) == sorted(map(tuple, vectors.select("id", "text_terms").collect()))
        assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 300 * features.DIM
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)
