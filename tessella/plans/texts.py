"""Queries of single text and score functions over values that are made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scoring, signals, text
from tessella.plans.queries import _t, query


@query("""WITH s AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS head, (o_custkey % 100) / 100.0 AS body, o_orderkey % 3 = 0 AS other, o_custkey % 4 = 0 AS resolved FROM orders)
SELECT o_orderkey, floor(greatest(head, body * 0.85) * 1000000.0 + 0.5) / 1000000.0 AS raw, floor(least(greatest((greatest(head, body * 0.85) - 0.08) / 0.67, 0), 1) * 1000000.0 + 0.5) / 1000000.0 AS semantic, CAST((CASE WHEN other THEN 0.5 ELSE 1.0 END) * (CASE WHEN resolved THEN 0.7 ELSE 1.0 END) AS DOUBLE) AS relevance FROM s""")
def semantic_and_relevance(spark, d):
    """Raw and calibrated similarity of head and body, and the relevance factor."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = scoring.raw_semantic((k % 100) / 100.0, (c % 100) / 100.0)
    return _t(spark, d, "orders").select("o_orderkey", scoring.rounded(raw).alias("raw"), scoring.rounded(scoring.calibrated(raw)).alias("semantic"), scoring.rounded(scoring.relevance(k % 3 == 0, c % 4 == 0)).alias("relevance"))


@query("SELECT o_orderkey, CAST(lpad(CAST(o_orderkey * 1234567 AS VARCHAR), 18, '3') || '1314' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS iban_ok FROM orders")
def iban_checks(spark, d):
    """Whether account numbers made from keys have the right check digits."""
    iban = F.concat(F.lit("DE"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 1234567).cast("string"), 18, "3"))
    return _t(spark, d, "orders").select("o_orderkey", text.iban_ok(iban).alias("iban_ok"))


@query("SELECT p_partkey, floor(CASE WHEN p_name = p_type THEN 0.0 ELSE levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)) END * 1000000.0 + 0.5) / 1000000.0 AS ratio FROM part")
def edit_ratios(spark, d):
    """Edit distance of each part's name and type over the longer length."""
    return _t(spark, d, "part").select("p_partkey", scoring.rounded(text.edit_ratio(F.col("p_name"), F.lower("p_type"))).alias("ratio"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['user', 'plan'] ELSE ['plan'] END AS variables, CASE WHEN c_custkey % 2 = 0 THEN 'Hi ' || ', on  ' ELSE 'On ' END || c_mktsegment AS plain FROM customer")
def template_variables(spark, d):
    """Variables of templates, and their text without them."""
    body = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Hi {{User}}, on {{plan|x}} {{user}}").otherwise("On {{ plan }}"), F.col("c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", text.list_variables(body).alias("variables"), text.strip_variables(body).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1500.5 WHEN p_partkey % 3 = 1 THEN p_partkey * 1000.0 ELSE p_partkey + 0.25 END AS number, CASE WHEN p_partkey % 2 = 0 THEN 'BTC' ELSE p_name END AS shown FROM part")
def written_numbers(spark, d):
    """Values of written numbers, and terms as they are shown."""
    k = F.col("p_partkey")
    written = F.when(k % 3 == 0, "1.500,50").when(k % 3 == 1, F.concat(k.cast("string"), F.lit("K"))).otherwise(F.concat(k.cast("string"), F.lit(",25")))
    return _t(spark, d, "part").select("p_partkey", signals.normal_number(written).alias("number"), signals.display_term(F.when(k % 2 == 0, "btc").otherwise(F.col("p_name"))).alias("shown"))
