"""Intent matches of messages and single macros, put together from the query's two parts."""

import os

import pytest

import __spark_entry__ as entry
from tessella.plans import messages

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
EACH = f"""WITH {messages._M}, {messages._TOP}, {messages._ASKED}, {messages._WEIGHTS}, {messages._MACROS}, {messages._RELATED},
pairs AS (SELECT o_orderkey, macro_id, weight AS score, NULL AS related_to FROM weights JOIN macro_intents USING (intent) UNION ALL SELECT o_orderkey, macro_id, weight * 0.5, w.intent FROM macro_intents i JOIN related r ON r.a = i.intent JOIN weights w ON w.intent = r.b)
SELECT o_orderkey, macro_id, CAST(score AS DOUBLE) AS score, related_to FROM pairs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey, macro_id ORDER BY score DESC, related_to IS NULL DESC, related_to DESC) = 1"""


def test_matches_of_all_macros(spark):
    """The parts joined are a row for each message and each macro of the whole of part that match, as SQL finds them macro by macro."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    out = entry.queries()["match_intents"](spark, SF).toPandas()
    assert set(out["part"]) == {"match", "member"}
    connection = duckdb.connect()
    for t in ("orders", "part"):
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    n_macros, n_found = connection.execute("select count(*) from part").fetchone()[0], (out["part"] == "member").sum()
    assert n_found == n_macros and out[out["part"] == "member"]["id"].is_unique
    connection.execute(f"create table wanted as {EACH}")
    connection.register("out", out)
    connection.execute("create table got as select m.id as o_orderkey, x.id as macro_id, m.score, m.related_to from out m join out x using (class_id) where m.part = 'match' and x.part = 'member'")
    assert connection.execute("select count(*) from got").fetchone() == connection.execute("select count(*) from wanted").fetchone()
    assert connection.execute("select count(*) from (select o_orderkey, macro_id, round(score, 9), related_to from got except select o_orderkey, macro_id, round(score, 9), related_to from wanted)").fetchone() == (0,)
    # a class's smallest macro stands for it in the pairs
    assert connection.execute("select count(*) from (select id, class_id, round(score, 9), related_to from out where part = 'match' except select o_orderkey, macro_id, round(score, 9), related_to from wanted)").fetchone() == (0,)
