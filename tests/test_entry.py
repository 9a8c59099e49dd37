import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_top3", "fact_rollup", "recommend", "cosine_top10"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stream_matches_batch(spark, tmp_path):
    from tessella.streaming import events

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = events.for_each_batch(events.event_stream(spark, str(tmp_path / "in"), e.schema), lambda b: b.where("event_type = 'click'"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.where("event_type = 'click'").count()
