"""Queries of the library's life cycle over a library derived from the test tables: parts are macros, their lines versions and facts, purchases uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import catalogue, library
from tessella.plans.queries import _t, query

AT = "2024-06-01 00:00:00"
_LIB = """macros AS (SELECT p_partkey AS macro_id, p_name || ' ' || CAST(p_partkey % 40 AS VARCHAR) AS title, CASE WHEN p_size % 9 > 0 THEN p_brand END AS category_id, [p_type, lower(p_type), ' ' || p_brand, ''] AS tags, p_size % 10 = 0 AS is_favorite,
 CASE WHEN p_size > 45 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) END AS archived_at, TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS updated_at FROM part),
versions AS (SELECT l_partkey AS macro_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS version, l_returnflag || ' body ' || CAST(CAST(l_quantity AS INTEGER) % 5 AS VARCHAR) AS body FROM lineitem),
facts AS (SELECT l_partkey AS macro_id, 'f' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS fact_key, 'Line of ' || CAST(l_orderkey AS VARCHAR) AS statement, CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'contradicted' WHEN l_returnflag = 'A' AND l_quantity > 30 THEN 'outdated' WHEN l_returnflag = 'N' THEN 'verified' ELSE 'unchecked' END AS status, l_quantity AS q FROM lineitem),
current AS (SELECT macro_id, max(version) AS current_version, max_by(body, version) AS body FROM versions GROUP BY macro_id),
categories AS (SELECT DISTINCT p_brand AS category_id, upper(p_brand) AS name FROM part WHERE p_brand <> 'Brand#1'),
uses AS (SELECT user_id AS macro_id, ts FROM events WHERE event_type = 'purchase'), counted AS (SELECT macro_id, count(*) AS use_count, max(ts) AS last_used FROM uses GROUP BY macro_id),
ids AS (SELECT macro_id FROM macros WHERE macro_id % 7 = 3)"""
_LISTED = f"""{_LIB}, rolled AS (SELECT macro_id, CASE WHEN bool_or(status = 'contradicted') THEN 'conflict' WHEN bool_or(status = 'outdated') THEN 'outdated' WHEN bool_and(status = 'verified') THEN 'verified' ELSE 'unverified' END AS verification, count(*) AS n_facts FROM facts GROUP BY macro_id),
listed AS (SELECT m.macro_id, m.title, m.category_id, m.tags, m.is_favorite, m.updated_at, c.current_version, c.body, coalesce(verification, 'unverified') AS verification, coalesce(n_facts, 0) AS n_facts, name AS category, coalesce(use_count, 0) AS use_count, last_used
 FROM macros m JOIN current c USING (macro_id) LEFT JOIN rolled USING (macro_id) LEFT JOIN categories USING (category_id) LEFT JOIN counted USING (macro_id) WHERE archived_at IS NULL)"""
_NATURAL = r"array_to_string(list_transform(regexp_extract_all(lower(title), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), '')"
_CLEAN = r"lower(trim(regexp_replace(title, '\s+', ' ', 'g')))"


def _library(spark, d) -> dict[str, DataFrame]:
    part, lines = _t(spark, d, "part"), _t(spark, d, "lineitem")
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(p_size)")
    macros = part.select(
        F.col("p_partkey").alias("macro_id"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 40).cast("string")).alias("title"), F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("category_id"),
        F.array("p_type", F.lower("p_type"), F.concat(F.lit(" "), "p_brand"), F.lit("")).alias("tags"), (F.col("p_size") % 10 == 0).alias("is_favorite"), F.when(F.col("p_size") > 45, day).alias("archived_at"), day.alias("updated_at"),
    )
    rows = library.with_versions(lines, "l_partkey", [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")])
    versions = rows.select(F.col("l_partkey").alias("macro_id"), "version", F.concat("l_returnflag", F.lit(" body "), (F.col("l_quantity").cast("int") % 5).cast("string")).alias("body"))
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    status = F.when((flag == "R") & (q > 40), "contradicted").when((flag == "A") & (q > 30), "outdated").when(flag == "N", "verified").otherwise("unchecked")
    key = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))
    facts = lines.select(F.col("l_partkey").alias("macro_id"), key.alias("fact_key"), F.concat(F.lit("Line of "), F.col("l_orderkey").cast("string")).alias("statement"), status.alias("status"), q.alias("q"))
    newest = versions.groupBy("macro_id").agg(F.max("version").alias("current_version"))
    uses = _t(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("macro_id"), "ts")
    categories = part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("category_id"), F.upper("p_brand").alias("name")).distinct()
    return {"macros": macros.join(newest, "macro_id", "left"), "versions": versions, "facts": facts, "categories": categories, "uses": uses, "ids": macros.where("macro_id % 7 = 3").select("macro_id")}


def _listed(spark, d) -> DataFrame:
    x = _library(spark, d)
    return catalogue.recorded_uses(catalogue.listing(x["macros"], x["versions"], x["facts"], x["categories"]), x["uses"])


@query(f"WITH {_LISTED} SELECT macro_id, title, category, current_version, body, verification, n_facts FROM listed")
def list_macros(spark, d):
    """Active macros with body, fact roll-up and category name."""
    return _listed(spark, d).select("macro_id", "title", "category", "current_version", "body", "verification", "n_facts")


@query(f"WITH {_LISTED} SELECT macro_id, title, verification FROM listed WHERE macro_id = 11")
def get_macro(spark, d):
    """One macro by its id."""
    return _listed(spark, d).where("macro_id = 11").select("macro_id", "title", "verification")


@query(f"WITH {_LIB} SELECT macro_id, coalesce(use_count, 0) AS use_count, CAST(floor(epoch(last_used)) AS BIGINT) AS last_used, (SELECT max(use_count) FROM counted WHERE macro_id IN (SELECT macro_id FROM macros)) AS most FROM macros LEFT JOIN counted USING (macro_id)")
def record_use(spark, d):
    """Uses of every macro, and the most of any."""
    x = _library(spark, d)
    counted = catalogue.recorded_uses(x["macros"], x["uses"])
    most = counted.agg(F.max("use_count").alias("most"))
    return counted.crossJoin(F.broadcast(most)).select("macro_id", "use_count", F.unix_timestamp("last_used").alias("last_used"), "most")  # one row


@query(f"WITH {_LIB} SELECT macro_id, CASE WHEN macro_id % 7 = 3 THEN coalesce(archived_at, TIMESTAMP '{AT}') ELSE archived_at END IS NOT NULL AS is_archived, CAST(floor(epoch(CASE WHEN macro_id % 7 = 3 THEN coalesce(archived_at, TIMESTAMP '{AT}') ELSE archived_at END)) AS BIGINT) AS archived_at FROM macros")
def archive_macros(spark, d):
    """State after some macros were archived; the first time stays."""
    x = _library(spark, d)
    out = catalogue.archived(x["macros"], x["ids"], F.lit(AT).cast("timestamp"))
    return out.select("macro_id", F.col("archived_at").isNotNull().alias("is_archived"), F.unix_timestamp("archived_at").alias("archived_at"))


@query(f"WITH {_LIB} SELECT macro_id, CASE WHEN macro_id % 7 <> 3 THEN archived_at END IS NOT NULL AS is_archived FROM macros")
def restore_macros(spark, d):
    """State after some macros were restored."""
    x = _library(spark, d)
    return catalogue.restored(x["macros"], x["ids"]).select("macro_id", F.col("archived_at").isNotNull().alias("is_archived"))


@query(f"WITH {_LIB} SELECT 'macros' AS name, count(*) AS n FROM macros WHERE macro_id NOT IN (SELECT macro_id FROM ids) UNION ALL SELECT 'versions', count(*) FROM versions WHERE macro_id NOT IN (SELECT macro_id FROM ids) UNION ALL SELECT 'facts', count(*) FROM facts WHERE macro_id NOT IN (SELECT macro_id FROM ids)")
def hard_delete(spark, d):
    """Rows left in each table after some macros were deleted."""
    x = _library(spark, d)
    left = catalogue.deleted({n: x[n] for n in ("macros", "versions", "facts")}, x["ids"])
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"WITH {_LIB}, marks AS (SELECT user_id AS macro_id, max_by(event_type = 'click', ts) AS mark FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id) SELECT macro_id, coalesce(mark, is_favorite) AS is_favorite FROM macros LEFT JOIN marks USING (macro_id)")
def set_favorites(spark, d):
    """Favourites after marks from events: the last one counts."""
    marks = _t(spark, d, "events").where("event_type IN ('click', 'view')").select(F.col("user_id").alias("macro_id"), "ts", (F.col("event_type") == "click").alias("is_favorite"))
    return catalogue.favoured(_library(spark, d)["macros"], marks).select("macro_id", "is_favorite")


@query(f"WITH {_LIB} SELECT v.macro_id, current_version + 1 AS version, v.body FROM versions v JOIN current c USING (macro_id) WHERE v.version = 1 AND macro_id % 3 = 0 AND v.body <> c.body")
def revert_versions(spark, d):
    """New versions from going back to the first one."""
    v = _library(spark, d)["versions"]
    return catalogue.reverted(v, v.where("version = 1 AND macro_id % 3 = 0").select("macro_id", "version"))


@query(f"""WITH {_LIB}, given AS (SELECT macro_id, fact_key, statement || '!' AS statement, CASE WHEN q > 45 THEN 'verified' END AS status FROM facts WHERE macro_id % 7 = 3 AND q > 30 UNION ALL SELECT macro_id, 'new', 'New fact', NULL FROM ids)
SELECT macro_id, fact_key, statement, status FROM facts WHERE macro_id NOT IN (SELECT macro_id FROM ids) UNION ALL SELECT g.macro_id, g.fact_key, g.statement, coalesce(g.status, f.status, 'unchecked') FROM given g LEFT JOIN facts f USING (macro_id, fact_key)""")
def replace_facts(spark, d):
    """Facts after whole lists were given for some macros."""
    x = _library(spark, d)
    old = x["facts"].where("macro_id % 7 = 3 AND q > 30").select("macro_id", "fact_key", F.concat("statement", F.lit("!")).alias("statement"), F.when(F.col("q") > 45, "verified").alias("status"))
    new = x["ids"].select("macro_id", F.lit("new").alias("fact_key"), F.lit("New fact").alias("statement"), F.lit(None).cast("string").alias("status"))
    return catalogue.replaced_facts(x["facts"], old.union(new))


@query(f"""WITH {_LIB}, marked AS (SELECT macro_id, fact_key, CASE WHEN q > 48 THEN 'outdated' WHEN q < 22 THEN 'unchecked' ELSE status END AS status, q > 48 AS checked FROM facts)
SELECT macro_id, CASE WHEN bool_or(status = 'contradicted') THEN 'conflict' WHEN bool_or(status = 'outdated') THEN 'outdated' WHEN bool_and(status = 'verified') THEN 'verified' ELSE 'unverified' END AS verification, count(*) AS n_facts, count_if(checked) AS n_checked FROM marked GROUP BY macro_id""")
def set_fact_status(spark, d):
    """Roll-up after some facts were marked, and how many carry a time of check."""
    facts = _library(spark, d)["facts"].withColumn("checked_at", F.lit(None).cast("timestamp"))
    marks = facts.where("q > 48 OR q < 22").select("macro_id", "fact_key", F.when(F.col("q") > 48, "outdated").otherwise("unchecked").alias("status"))
    now = catalogue.with_status(facts, marks, F.lit(AT).cast("timestamp"))
    return library.rollup(now, "macro_id").join(now.groupBy("macro_id").agg(F.count("checked_at").alias("n_checked")), "macro_id")


@query(f"""WITH {_LIB}, w AS (SELECT macro_id, status, count(*) AS n, list_sort(list(statement))[1:3] AS few FROM facts WHERE status IN ('contradicted', 'outdated', 'unchecked') GROUP BY ALL)
SELECT macro_id, list_sort(list(CAST(n AS VARCHAR) || ' ' || status || ': ' || array_to_string(few, '; '))) AS warnings FROM w GROUP BY macro_id""")
def verification_warnings(spark, d):
    """Warning lines of each macro."""
    return catalogue.warning_lines(_library(spark, d)["facts"])


@query(f"""WITH {_LIB}, c AS (SELECT macro_id, title, category_id, list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> '') AS t FROM macros)
SELECT macro_id, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i) AS tags, ['b'] AS intents FROM c""")
def canonical_content(spark, d):
    """Clean lists of each macro."""
    m = _library(spark, d)["macros"].withColumn("body", F.lit(" x ")).withColumn("intents", F.array(F.lit("b"), F.lit("zzz"), F.lit("b")))
    return catalogue.canonical(m, ("a", "b")).select("macro_id", "tags", "intents")


@query(f"WITH {_LISTED} SELECT macro_id, verification, array_to_string(list_filter([title, array_to_string(tags, ' '), coalesce(category, '')], lambda x: x <> ''), ' · ') AS haystack FROM listed WHERE verification IN ('outdated', 'conflict', 'unverified') AND category_id = 'Brand#4'")
def filter_library(spark, d):
    """Macros of a category that need attention, with their search text."""
    found = catalogue.filtered(_listed(spark, d), category="Brand#4", attention=True)
    return found.select("macro_id", "verification", catalogue.haystack(F.col("title"), F.lit(None).cast("string"), F.col("tags"), F.col("category")).alias("haystack"))


@query(f"""WITH {_LISTED}, t AS (SELECT macro_id, CASE WHEN starts_with(lower(title), 'red') THEN 1 WHEN contains(lower(array_to_string(list_filter([title, array_to_string(tags, ' '), coalesce(category, '')], lambda x: x <> ''), ' · ')), 'red') THEN 2 WHEN contains(lower(body), 'red') THEN 3 END AS tier FROM listed) SELECT macro_id, tier FROM t WHERE tier IS NOT NULL""")
def search_library(spark, d):
    """Macros that hold a text, by tier."""
    return catalogue.searched(_listed(spark, d), " Red ").select("macro_id", "tier")


@query(f"WITH {_LISTED} SELECT macro_id, row_number() OVER (ORDER BY {_NATURAL}, macro_id) AS place FROM listed QUALIFY place <= 50")
def order_by_title(spark, d):
    """First fifty macros by natural title order."""
    return catalogue.ordered(_listed(spark, d), "title", 50).select("macro_id", "place")


@query(f"WITH {_LISTED} SELECT macro_id, use_count, row_number() OVER (ORDER BY use_count DESC, last_used DESC NULLS LAST, {_NATURAL}, macro_id) AS place FROM listed QUALIFY place <= 50")
def order_by_use(spark, d):
    """First fifty macros by use."""
    return catalogue.ordered(_listed(spark, d), "most_used", 50).select("macro_id", "use_count", "place")


@query(f"WITH {_LISTED} SELECT macro_id, row_number() OVER (ORDER BY is_favorite DESC, use_count DESC, last_used DESC NULLS LAST, macro_id) AS place FROM listed QUALIFY place <= 50")
def order_quick(spark, d):
    """First fifty macros of the quick search without a text."""
    return catalogue.ordered(_listed(spark, d), "quick", 50).select("macro_id", "place")


_ITEMS = "items AS (SELECT s_suppkey AS pos, (SELECT any_value(title) FROM macros WHERE macro_id = s_suppkey // 2 * 3) AS t, s_suppkey FROM supplier)"


def _items(x: dict[str, DataFrame], spark, d) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.expr("s_suppkey div 2 * 3").alias("macro_id"))
    return s.join(x["macros"].select("macro_id", "title"), "macro_id").select("pos", F.upper("title").alias("title"), F.concat(F.lit("N body "), (F.col("pos") % 5).cast("string")).alias("body"))


_PLAN = f"""{_LIB}, known AS (SELECT macro_id, {_CLEAN} AS k, archived_at, current_version, body FROM macros JOIN current USING (macro_id)),
live AS (SELECT k, min(macro_id) AS macro_id, min_by(current_version, macro_id) AS current_version, min_by(body, macro_id) AS body FROM known WHERE archived_at IS NULL GROUP BY k),
items AS (SELECT s_suppkey AS pos, {_CLEAN} AS k, 'N body ' || CAST(s_suppkey % 5 AS VARCHAR) AS body FROM supplier JOIN macros ON macro_id = s_suppkey // 2 * 3),
judged AS (SELECT pos, i.k, i.body, l.macro_id, l.current_version, l.body AS old, row_number() OVER (PARTITION BY i.k ORDER BY pos) AS turn, EXISTS (SELECT 1 FROM known n WHERE n.archived_at IS NOT NULL AND n.k = i.k AND n.body = i.body) AS gone FROM items i LEFT JOIN live l USING (k)),
planned AS (SELECT *, CASE WHEN gone AND macro_id IS NULL THEN 'skip' WHEN old = body THEN 'skip' WHEN macro_id IS NOT NULL OR turn > 1 THEN 'update' ELSE 'create' END AS action FROM judged)"""


@query(f"WITH {_PLAN} SELECT pos, action, CASE WHEN action <> 'create' THEN macro_id END AS macro_id, CASE WHEN action = 'create' THEN 1 ELSE current_version + CASE WHEN action = 'update' THEN 1 ELSE 0 END END AS version FROM planned")
def import_items(spark, d):
    """What an import does with each item, under the policy of new versions."""
    x = _library(spark, d)
    return catalogue.imported(x["macros"], x["versions"], _items(x, spark, d), "new_version")


@query(f"WITH {_PLAN} SELECT count_if(NOT (macro_id IS NOT NULL OR turn > 1 OR gone)) AS n_create, CAST(0 AS BIGINT) AS n_update, count_if(macro_id IS NOT NULL OR turn > 1 OR gone) AS n_skip FROM planned")
def import_counts(spark, d):
    """Totals of an import that skips duplicates."""
    x = _library(spark, d)
    return catalogue.import_totals(catalogue.imported(x["macros"], x["versions"], _items(x, spark, d), "skip"))


@query("SELECT c_custkey AS macro_id, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS notes, CASE WHEN c_custkey % 2 = 0 THEN ['new'] ELSE [c_name] END AS tags FROM customer")
def merge_import(spark, d):
    """Imported rows over current ones: empty metadata keeps what is there."""
    c = _t(spark, d, "customer")
    now = c.select(F.col("c_custkey").alias("macro_id"), F.col("c_name").alias("notes"), F.array("c_name").alias("tags"))
    given = c.select(F.col("c_custkey").alias("macro_id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("notes"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return catalogue.merged_update(now, given, ["notes"], ["tags"])


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')")
def append_events(spark, d):
    """Events of known kinds without free text."""
    return catalogue.accepted_events(_t(spark, d, "events"), ["event_id", "ts", "event_type"], ("view", "click", "purchase", "signup"))


@query("WITH p AS (SELECT event_id AS pos, 'problem ' || CAST(event_id AS VARCHAR) AS message FROM events WHERE event_type = 'error') SELECT * FROM (SELECT * FROM p ORDER BY pos LIMIT 200) UNION ALL SELECT NULL, '...and ' || CAST(count(*) - 200 AS VARCHAR) || ' more' FROM p HAVING count(*) > 200")
def problem_log(spark, d):
    """A log of at most 200 problems and how many more there are."""
    return catalogue.problem_log(_t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("pos"), F.concat(F.lit("problem "), F.col("event_id").cast("string")).alias("message")))


@query("SELECT count(*) AS n, coalesce(sum(l_linenumber), 0) AS l_linenumber FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1900-01'")
def empty_month(spark, d):
    """Sums of a month in which nothing happened: one row of zeros."""
    return catalogue.month_sums(_t(spark, d, "lineitem"), "l_shipdate", "1900-01", ["l_linenumber"])


_RESULTS = "r AS (SELECT o_orderpriority AS grp, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS expected, CASE WHEN o_orderkey % 11 = 0 THEN CAST([] AS BIGINT[]) ELSE [o_custkey % 4, (o_custkey + 1) % 4, (o_custkey + o_orderkey) % 6] END AS top, o_orderkey AS took FROM orders)"


@query(f"""WITH {_RESULTS}, p AS (SELECT grp, took, row_number() OVER (PARTITION BY grp ORDER BY took) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM r)
SELECT r.grp, count_if(expected IS NOT NULL) AS n_asked, count_if(coalesce(top[1] = expected, false)) AS top1, count_if(coalesce(list_contains(top[1:3], expected), false)) AS top3, count_if(expected IS NULL) AS n_none, count_if(expected IS NULL AND len(top) = 0) AS none_found, count_if(expected IS NOT NULL AND len(top) = 0) AS false_none, any_value(p.took) AS p95
FROM r JOIN p ON p.grp = r.grp AND p.i = floor(p.n * 0.95) GROUP BY r.grp""")
def evaluate_ranking(spark, d):
    """Top-1, top-3, detected and false NONE and p95 of ranked results, by set."""
    o, k, c = _t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    top = F.when(k % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c % 4, (c + 1) % 4, (c + k) % 6))
    r = o.select(F.col("o_orderpriority").alias("grp"), F.when(k % 5 > 0, k % 4).alias("expected"), top.alias("top"), k.alias("took"))
    return catalogue.evaluated(r, "grp")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN floor((o_orderkey * (CASE o_orderkey % 3 WHEN 0 THEN 3.0 ELSE 0.8 END) + o_custkey * (CASE o_orderkey % 3 WHEN 0 THEN 15.0 ELSE 4.0 END) + 100 * (CASE o_orderkey % 3 WHEN 0 THEN 3.0 ELSE 0.8 END) * 1.25 + 50 * (CASE o_orderkey % 3 WHEN 0 THEN 3.0 ELSE 0.8 END) * 0.1) / 1e6 * 1e6 + 0.5) / 1e6 END AS cost_usd FROM orders")
def token_costs(spark, d):
    """Cost of token counts by a price table."""
    usage = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("model"), F.col("o_orderkey").alias("input"), F.col("o_custkey").alias("output"), F.lit(100).alias("cache_write"), F.lit(50).alias("cache_read"))
    prices = spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 0.8, 4.0)], "model string, in_price double, out_price double")
    return catalogue.priced(usage, prices).select("o_orderkey", (F.floor(F.col("cost_usd") * 1e6 + 0.5) / 1e6).alias("cost_usd"))


@query(f"WITH {_LIB} SELECT DISTINCT macro_id, fact_key, status FROM facts WHERE status IN ('verified', 'unchecked')")
def usable_facts(spark, d):
    """Facts that a reply may use."""
    return catalogue.usable_facts(_library(spark, d)["facts"]).select("macro_id", "fact_key", "status")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS macro_id, CAST(l_quantity AS BIGINT) AS confidence FROM lineitem), o AS (SELECT l_orderkey, macro_id, 100 - confidence AS confidence FROM l WHERE macro_id <= 3), b AS (SELECT l_orderkey, min(confidence) AS least FROM o GROUP BY l_orderkey)
SELECT l.l_orderkey, l.macro_id, coalesce(o.confidence, least(l.confidence, b.least)) AS confidence FROM l LEFT JOIN o USING (l_orderkey, macro_id) LEFT JOIN b USING (l_orderkey)""")
def merge_rankings(spark, d):
    """Local rows with another ranker's confidence, others capped at its least."""
    own = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("macro_id"), F.col("l_quantity").cast("long").alias("confidence"))
    other = own.where("macro_id <= 3").select("l_orderkey", "macro_id", (100 - F.col("confidence")).alias("confidence"))
    return catalogue.shown(own, other, ["l_orderkey"])


@query(f"""WITH {_LIB}, f AS (SELECT macro_id, fact_key, CAST(CAST(q AS INTEGER) AS VARCHAR) AS value FROM facts), r AS (SELECT macro_id, title || ', up to ' || CAST(macro_id % 50 AS VARCHAR) || ' EUR.' AS reply FROM macros)
SELECT DISTINCT macro_id, fact_key FROM f JOIN r USING (macro_id) WHERE contains(' ' || regexp_replace(lower(reply), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g') || ' ', ' ' || value || ' ')""")
def used_facts(spark, d):
    """Facts whose value a reply holds."""
    x = _library(spark, d)
    facts = x["facts"].select("macro_id", "fact_key", F.col("q").cast("int").cast("string").alias("value"))
    replies = x["macros"].select("macro_id", F.concat("title", F.lit(", up to "), (F.col("macro_id") % 50).cast("string"), F.lit(" EUR.")).alias("reply"))
    return catalogue.facts_in_reply(facts, replies)
