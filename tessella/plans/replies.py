"""Queries of combined replies, drafts, warnings and pseudonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import classify, signals
from tessella.operators import replies
from tessella.plans.messages import _M, _RISKS, _messages, _FOREIGN
from tessella.plans.queries import _t, query

_BODIES = """bodies AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS slot, l_partkey % 3 AS k, l_suppkey % 4 AS m, l_partkey % 2 AS c FROM lineitem)"""


@query(f"""WITH {_BODIES}, p AS (SELECT l_orderkey, slot, CASE WHEN k = 0 THEN 'Hello Ann,' ELSE '' END AS greeting, unnest(['Your order is on the way ' || CAST(m AS VARCHAR), 'Short ' || CAST(m AS VARCHAR)]) AS line, unnest([0, 1]) AS pos, CASE WHEN c = 0 THEN 'Kind regards, Bo ' || CAST(m AS VARCHAR) ELSE '' END AS closing FROM bodies),
e AS (SELECT l_orderkey, coalesce(min_by(greeting, slot) FILTER (WHERE greeting <> ''), '') AS greeting, coalesce(max_by(closing, slot) FILTER (WHERE closing <> ''), '') AS closing FROM p GROUP BY l_orderkey),
n AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY slot, pos) AS middle FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY slot, pos) AS turn FROM p) WHERE line LIKE 'Short%' OR turn = 1 GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter([greeting, middle, closing], lambda x: x <> ''), chr(10) || chr(10)) AS reply FROM e JOIN n USING (l_orderkey)""")
def combine_replies(spark, d):
    """One reply for each order from its lines' bodies."""
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    m = (F.col("l_suppkey") % 4).cast("string")
    body = F.concat(F.when(F.col("l_partkey") % 3 == 0, "Hello Ann,\n\n").otherwise(""), F.lit("Your order is on the way "), m, F.lit("\nShort "), m, F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("\n\nKind regards, Bo "), m)).otherwise(""))
    return replies.combined(_t(spark, d, "lineitem").select("l_orderkey", slot.alias("slot"), body.alias("body")), ["l_orderkey"])


@query("SELECT o_custkey, 'Hi ' || any_value(c_name) || ',' || chr(10) || chr(10) || string_agg('[ENTER ANSWER: Where is ' || CAST(o_orderkey AS VARCHAR) || '?]', chr(10) ORDER BY o_orderkey) AS draft FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def draft_replies(spark, d):
    """A skeleton reply for each customer, with a placeholder for each order."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = rows.select("o_custkey", "c_name", F.col("o_orderkey").alias("place"), F.concat(F.lit("Where is "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("text"))
    return replies.drafted(asked, ["o_custkey"], F.col("c_name"))


@query(f"WITH {_M} SELECT o_orderkey, list_filter([CASE WHEN len({_RISKS}) > 0 THEN 'responsible gambling' END, CASE WHEN {_FOREIGN} THEN 'not in English' END, CASE o_orderkey % 3 WHEN 0 THEN 'macro is outdated' WHEN 1 THEN 'macro is conflict' END], lambda x: x IS NOT NULL) AS warnings FROM n")
def reply_warnings(spark, d):
    """Warnings that go with the reply to each message."""
    k = F.col("o_orderkey") % 3
    state = F.when(k == 0, "outdated").when(k == 1, "conflict").otherwise("verified")
    m = _messages(spark, d)
    return m.select("o_orderkey", replies.warnings(classify.phrases(F.col("message"), classify.RISK), signals.not_english(F.col("message")), state).alias("warnings"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', code ' || CAST(c_custkey AS VARCHAR) || ' and [X_1].' AS reply FROM customer")
def restore_pseudonyms(spark, d):
    """Replies with their tokens replaced by the values again."""
    c = _t(spark, d, "customer")
    pairs = F.array(F.struct(F.lit("[NAME_1]").alias("token"), F.col("c_name").alias("value")), F.struct(F.lit("[NAME_1]2").alias("token"), F.col("c_custkey").cast("string").alias("value")))
    return replies.restored(c.select("c_custkey", F.lit("Dear [NAME_1], code [NAME_1]2 and [X_1].").alias("reply")), c.select("c_custkey", F.inline(pairs)), ["c_custkey"])
