"""An import into a library made of the given parts: events are the items, in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import imports
from tessella.plans.queries import _t, query

_K = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"


def _tables(spark, d):
    part = _t(spark, d, "part")
    macros = part.select(F.col("p_partkey").alias("macro_id"), F.col("p_name").alias("title"), F.lit(1).cast("long").alias("current_version"), F.lit(False).alias("archived"), F.lit(False).alias("is_favorite"))
    versions = part.select(F.col("p_partkey").alias("macro_id"), F.lit(1).cast("long").alias("version"), F.col("p_name").alias("title"), F.col("p_type").alias("body"))
    facts = part.select(F.col("p_partkey").alias("macro_id"), F.lit("size").alias("fact_key"), F.col("p_size").cast("string").alias("value"))
    rows = _t(spark, d, "events").join(part, F.col("user_id") == F.col("p_partkey"), "left")
    given = F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit("props").alias("fact_key"), F.col("props").alias("value"))))
    new = F.when(F.col("event_type") == "click", F.concat_ws(" ", "p_name", "p_brand", "p_type")).otherwise(F.col("p_name"))
    items = rows.select(F.col("event_id").alias("pos"), new.alias("title"), F.concat_ws(" ", "p_type", "event_type").alias("body"), F.lit(False).alias("archived"), (F.col("value") > 50).alias("is_favorite"), given.alias("facts"))
    return {"macros": macros, "versions": versions, "facts": facts}, items


@query(f"""WITH i AS (SELECT event_id AS pos, CASE WHEN event_type = 'click' THEN concat_ws(' ', p_name, p_brand, p_type) ELSE p_name END AS title, concat_ws(' ', p_type, event_type) AS body, coalesce(value > 50, false) AS fav FROM events LEFT JOIN part ON user_id = p_partkey),
s AS (SELECT {_K} AS k, min(p_partkey) AS id, arg_min(title || chr(1) || p_type, p_partkey) AS mark FROM (SELECT *, p_name AS title FROM part) GROUP BY 1), j AS (SELECT *, coalesce({_K}, '') AS k, coalesce(title, '') || chr(1) || body AS mark FROM i),
l AS (SELECT j.*, s.id, coalesce(lag(j.mark) OVER (PARTITION BY k ORDER BY pos), s.mark) AS before FROM j LEFT JOIN s USING (k)),
g AS (SELECT k, id, min(pos) AS first, arg_max(title, pos) AS title, bool_or(fav) AS fav, count(*) FILTER (WHERE before IS DISTINCT FROM mark) AS n FROM l GROUP BY k, id)
SELECT coalesce(id, (SELECT max(p_partkey) FROM part) + row_number() OVER (PARTITION BY id IS NULL ORDER BY first)) AS macro_id, title, CASE WHEN id IS NULL THEN 0 ELSE 1 END + n AS current_version, fav AS is_favorite FROM g
UNION ALL SELECT p_partkey, p_name, 1, false FROM part WHERE p_partkey NOT IN (SELECT id FROM g WHERE id IS NOT NULL)""")
def imported_macros(spark, d):
    """Macros after an import under which items of known titles become versions."""
    tables, items = _tables(spark, d)
    plan = imports.planned(tables["macros"], tables["versions"], items, "new_version")
    return imports.applied(**tables, plan=plan)["macros"].drop("archived")
