"""Life cycle and listing of a reply library, as transformations of whole tables.

Tables: macros (macro_id, title, category_id, tags, is_favorite, archived_at, updated_at, current_version), versions (macro_id, version, body),
facts (macro_id, fact_key, statement, status, checked_at), categories (category_id, name), uses (macro_id, ts). Each
function returns the new state of the table that it changes; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import title_key
from tessella.operators import library

ATTENTION = ("outdated", "conflict", "unverified")
STATUSES = ("unchecked", "verified", "outdated", "contradicted", "unverifiable")
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def active(macros: DataFrame) -> DataFrame:
    """Macros that aren't archived."""
    return macros.where("archived_at IS NULL")


def listing(macros: DataFrame, versions: DataFrame, facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Active macros with the body of their current version, the roll-up of their facts and their category's name.

    A macro whose current version can't be found is left out; one without facts is unverified.
    """
    now = versions.select("macro_id", F.col("version").alias("current_version"), "body")
    rolled = library.rollup(facts, "macro_id")
    out = active(macros).join(now, ["macro_id", "current_version"]).join(rolled, "macro_id", "left").join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left")
    return out.fillna({"verification": "unverified", "n_facts": 0})


def recorded_uses(macros: DataFrame, uses: DataFrame) -> DataFrame:
    """Adds use_count and last_used; a macro that was never used has 0 and null."""
    counted = uses.groupBy("macro_id").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used"))
    return macros.join(counted, "macro_id", "left").fillna({"use_count": 0})


def archived(macros: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Archives the macros of these ids; one that is archived already keeps its time."""
    hit = ids.select("macro_id").distinct().withColumn("_hit", F.lit(True))
    return macros.join(hit, "macro_id", "left").withColumn("archived_at", F.when(F.col("_hit"), F.coalesce("archived_at", at)).otherwise(F.col("archived_at"))).drop("_hit")


def restored(macros: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("macro_id").distinct().withColumn("_hit", F.lit(True))
    return macros.join(hit, "macro_id", "left").withColumn("archived_at", F.when(F.col("_hit").isNull(), F.col("archived_at"))).drop("_hit")


def unknown_ids(macros: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that no macro has: an error for whoever asked for the change."""
    return ids.select("macro_id").distinct().join(macros, "macro_id", "left_anti")


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these macros: the macros themselves, their versions, facts and vectors."""
    gone = ids.select("macro_id").distinct()
    return {name: t.join(gone, "macro_id", "left_anti") for name, t in tables.items()}


def favoured(macros: DataFrame, marks: DataFrame) -> DataFrame:
    """Sets is_favorite to the last mark (macro_id, ts, is_favorite) of each macro."""
    last = marks.groupBy("macro_id").agg(F.max_by("is_favorite", "ts").alias("_new"))
    return macros.join(last, "macro_id", "left").withColumn("is_favorite", F.coalesce("_new", "is_favorite")).drop("_new")


def reverted(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """New versions that copy an old one (macro_id, version); none where the current content is the same."""
    newest = library.latest(versions, "macro_id", "version").select("macro_id", F.col("version").alias("_now"), F.col("body").alias("_body"))
    old = versions.join(wanted.select("macro_id", "version").distinct(), ["macro_id", "version"])
    changed = old.join(newest, "macro_id").where(F.trim("body") != F.trim("_body"))
    return changed.select("macro_id", (F.col("_now") + 1).alias("version"), "body")


def replaced_facts(facts: DataFrame, given: DataFrame) -> DataFrame:
    """The facts after whole lists (macro_id, fact_key, statement, status) were given for some macros.

    A known key is updated and keeps its status unless one is given; others are new and unchecked; keys that aren't given go.
    """
    touched = given.select("macro_id").distinct()
    rest = facts.join(touched, "macro_id", "left_anti").select("macro_id", "fact_key", "statement", "status")
    old = facts.select("macro_id", "fact_key", F.col("status").alias("_old"))
    new = given.join(old, ["macro_id", "fact_key"], "left").withColumn("status", F.coalesce("status", "_old", F.lit("unchecked")))
    return rest.unionByName(new.select("macro_id", "fact_key", "statement", "status"))


def with_status(facts: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """Sets the status of facts (macro_id, fact_key, status); the time of the check is null for unchecked."""
    new = marks.where(F.col("status").isin(*STATUSES)).select("macro_id", "fact_key", F.col("status").alias("_new"))
    out = facts.join(new, ["macro_id", "fact_key"], "left")
    checked = F.when(F.col("_new").isNull(), F.col("checked_at")).when(F.col("_new") != "unchecked", at)
    return out.withColumn("checked_at", checked).withColumn("status", F.coalesce("_new", "status")).drop("_new")


def warning_lines(facts: DataFrame, each: int = 3) -> DataFrame:
    """macro_id and warnings: a line for each bad status with its count and the first statements, which the line's form limits to `each`."""
    bad = facts.where(F.col("status").isin("contradicted", "outdated", "unchecked"))
    listed = bad.groupBy("macro_id", "status").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("statement")), 1, each).alias("some"))
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("status"), F.lit(": "), F.array_join("some", "; "))
    return listed.groupBy("macro_id").agg(F.array_sort(F.collect_list(line)).alias("warnings"))


def unique_list(items: Column) -> Column:
    """Trimmed items without empties; of spellings that differ in case only the first stays."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def canonical(macros: DataFrame, intents: tuple[str, ...]) -> DataFrame:
    """Canonical content: trimmed texts, clean lists, known intents only, no empty category."""
    return macros.withColumns({
        "title": F.trim("title"), "body": F.trim("body"), "tags": unique_list(F.col("tags")),
        "intents": F.filter(F.array_distinct("intents"), lambda x: x.isin(*intents)), "category_id": F.nullif(F.trim("category_id"), F.lit("")),
    })


def haystack(title: Column, shortcut: Column, tags: Column, category: Column) -> Column:
    """What the library search looks through: the parts that aren't empty, with dots between."""
    parts = F.array(title, shortcut, F.array_join(tags, " "), category)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " · ")


#: Titles compare by this collation: case and marks don't count.
COLLATION = "UNICODE_CI_AI"


def natural_key(title: Column) -> Column:
    """Collated sort key of a title: case and marks don't count, numbers of any length go by value.

    A number stands as the count of its digits, in five digits, and the digits themselves, so that collation compares lengths first.
    """
    parts = F.regexp_extract_all(title, F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    sized = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 5, "0"), digits(x))).otherwise(x))
    return F.collate(F.array_join(sized, ""), COLLATION)


#: Orders of the library list; each ends in the title.
ORDERS = {
    "title": lambda: [natural_key(F.col("title")), F.col("macro_id")],
    "most_used": lambda: [F.desc("use_count"), F.desc_nulls_last("last_used"), natural_key(F.col("title")), F.col("macro_id")],
    "recently_used": lambda: [F.desc_nulls_last("last_used"), F.desc("use_count"), natural_key(F.col("title")), F.col("macro_id")],
    "recently_updated": lambda: [F.desc_nulls_last("updated_at"), natural_key(F.col("title")), F.col("macro_id")],
    "quick": lambda: [F.desc("is_favorite"), F.desc("use_count"), F.desc_nulls_last("last_used"), F.col("macro_id")],
}


def filtered(listed: DataFrame, category: str | None = None, favorites: bool = False, attention: bool = False) -> DataFrame:
    """Library filters: a category ("" for none), favourites, verification that needs attention."""
    if category is not None:
        listed = listed.where(F.col("category_id").isNull() if category == "" else F.col("category_id") == category)
    if favorites:
        listed = listed.where("is_favorite")
    return listed.where(F.col("verification").isin(*ATTENTION)) if attention else listed


def searched(listed: DataFrame, text: str, body: str = "body") -> DataFrame:
    """Rows that hold a text, with a tier: 1 the title begins with it, 2 the haystack holds it, 3 the body does (two characters at least)."""
    q = F.lit(" ".join(text.lower().split()))
    hay = F.lower(haystack(F.col("title"), F.lit(None).cast("string"), F.col("tags"), F.col("category")))
    tier = F.when(F.startswith(F.lower("title"), q), 1).when(F.contains(hay, q), 2).when((F.length(q) >= 2) & F.contains(F.lower(body), q), 3)
    return listed.withColumn("tier", tier).where("tier IS NOT NULL")


def ordered(listed: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` rows in an order, with their place. The top of each partition is taken before they meet."""
    top = listed.orderBy(*ORDERS[order]()).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ORDERS[order]())).cast("long"))  # `most` rows


def imported(macros: DataFrame, versions: DataFrame, items: DataFrame, policy: str) -> DataFrame:
    """What an import would do with each item (pos, title, body): action, macro_id or null, version.

    policy is skip, new_version or create_copy. An item whose body is that of an archived macro of the same title is skipped; a second item
    of a title within the import counts as a duplicate of the first. Equal content is never a new version.
    """
    known = macros.select("macro_id", title_key(F.col("title")).alias("k"), "archived_at", "current_version")
    bodies = versions.select("macro_id", F.col("version").alias("current_version"), F.sha2(F.trim("body"), 256).alias("mark"))
    known = known.join(bodies, ["macro_id", "current_version"])
    live = known.where("archived_at IS NULL").groupBy("k").agg(F.min_by(F.struct("macro_id", "current_version", "mark"), "macro_id").alias("same"))
    kept = known.where("archived_at IS NOT NULL").select("k", "mark").distinct().withColumn("gone", F.lit(True))
    rows = items.select("*", title_key(F.col("title")).alias("k"), F.sha2(F.trim("body"), 256).alias("mark"))
    turn = F.row_number().over(Window.partitionBy("k").orderBy("pos"))
    rows = rows.withColumn("turn", turn).join(live, "k", "left").join(kept, ["k", "mark"], "left")
    duplicate = F.col("same").isNotNull() | (F.col("turn") > 1)
    if policy == "create_copy":
        action = F.lit("create")
    elif policy == "new_version":
        action = F.when(F.col("same.mark") == F.col("mark"), "skip").when(duplicate, "update").otherwise("create")
    else:
        action = F.when(duplicate, "skip").otherwise("create")
    action = F.when(F.col("gone") & F.col("same").isNull(), "skip").otherwise(action)
    updated = F.col("same.current_version") + F.when(F.col("action") == "update", 1).otherwise(0)
    return rows.withColumn("action", action).select("pos", "action", F.when(F.col("action") != "create", F.col("same.macro_id")).alias("macro_id"), F.when(F.col("action") == "create", 1).otherwise(updated).cast("long").alias("version"))


def import_totals(planned: DataFrame) -> DataFrame:
    """One row: how many items an import creates, updates and skips."""
    return planned.agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("create", "update", "skip")])


def merged_update(current: DataFrame, given: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Imported rows over current ones of the same macro_id: text as given, empty metadata keeps what is there."""
    old = current.select("macro_id", *[F.col(c).alias(f"_{c}") for c in (*texts, *lists)])
    out = given.join(old, "macro_id", "left")
    new = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), f"_{c}") for c in texts} | {c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.col(f"_{c}")) for c in lists}
    return out.withColumns(new).drop(*[f"_{c}" for c in (*texts, *lists)])


def accepted_events(events: DataFrame, fields: list[str], kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Events of known kinds, with the allowed fields only."""
    return events.where(F.col("event_type").isin(*kinds)).select(*fields)


def problem_log(problems: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` messages (pos, message) by position, and one line for how many more there are: a log's own form."""
    n = problems.count()
    first = problems.orderBy("pos").limit(most).select("pos", "message")
    if n <= most:
        return first
    return first.unionByName(problems.sparkSession.createDataFrame([(None, f"...and {n - most} more")], first.schema))


def month_sums(rows: DataFrame, ts: str, month: str, sums: list[str]) -> DataFrame:
    """Exactly one row for a month: count, and sums that are 0 where nothing is there."""
    own = rows.where(F.date_format(ts, "yyyy-MM") == month)
    return own.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def evaluated(results: DataFrame, by: str) -> DataFrame:
    """Metrics of ranked results (expected, top: array of keys, confidence, took) by set.

    expected null means that nothing should match: detected where the result is empty. p95 is the value at place floor(n * 0.95), from 0.
    """
    asked = F.col("expected").isNotNull()
    first = F.coalesce(F.get("top", F.lit(0)) == F.col("expected"), F.lit(False))
    among = F.coalesce(F.array_contains(F.slice("top", 1, 3), F.col("expected")), F.lit(False))
    none = F.size("top") == 0
    out = results.groupBy(by).agg(
        F.count_if(asked).alias("n_asked"), F.count_if(asked & first).alias("top1"), F.count_if(asked & among).alias("top3"),
        F.count_if(~asked).alias("n_none"), F.count_if(~asked & none).alias("none_found"), F.count_if(asked & none).alias("false_none"),
    )
    place = F.row_number().over(Window.partitionBy(by).orderBy("took")) - 1
    n = F.count("*").over(Window.partitionBy(by))
    p95 = results.withColumn("_p", place).withColumn("_n", n).where("_p = floor(_n * 0.95)").select(by, F.col("took").alias("p95"))
    return out.join(p95, by, "left")


def priced(usage: DataFrame, prices: DataFrame, write_factor: float = 1.25, read_factor: float = 0.1) -> DataFrame:
    """Adds cost_usd of token counts (model, input, output, cache_write, cache_read) by a table of prices a million tokens; unknown models cost null."""
    out = usage.join(prices, "model", "left")
    cost = F.col("input") * F.col("in_price") + F.col("output") * F.col("out_price") + F.col("cache_write") * F.col("in_price") * write_factor + F.col("cache_read") * F.col("in_price") * read_factor
    return out.withColumn("cost_usd", cost / 1e6).drop("in_price", "out_price")


def usable_facts(facts: DataFrame) -> DataFrame:
    """Facts that a reply may use: verified or unchecked, each once."""
    return facts.where(F.col("status").isin("verified", "unchecked")).dropDuplicates(["macro_id", "fact_key"])


def shown(local: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows in their order, with another ranker's confidence where it has one; those that it leaves out are capped at its least."""
    least = other.groupBy(*keys).agg(F.min("confidence").alias("_least"))
    out = local.join(other.select(*keys, "macro_id", F.col("confidence").alias("_other")), [*keys, "macro_id"], "left").join(least, keys, "left")
    return out.withColumn("confidence", F.coalesce("_other", F.least("confidence", "_least"))).drop("_other", "_least")


def facts_in_reply(facts: DataFrame, replies: DataFrame) -> DataFrame:
    """macro_id, fact_key of the facts whose value a reply (macro_id, reply) holds, as a whole word."""
    both = facts.join(replies, "macro_id")
    found = F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("reply"), r"[^\p{L}\p{N}.]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.lower("value"), F.lit(" ")))
    return both.where(F.col("value").isNotNull() & (F.col("value") != "") & found).select("macro_id", "fact_key").distinct()
