"""Reply-library operations over tables: versions, facts, usage, categories, retention, duplicates, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import title_key


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest version of each key, by a partial aggregate rather than a sort."""
    row = F.struct(*versions.columns)
    return versions.groupBy(key).agg(F.max_by(row, F.col(order)).alias("x")).select("x.*")


def rollup(facts: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Verification of each key: conflict if any fact is contradicted, outdated if any is, verified if all are, else unverified."""
    s = F.col(status)
    state = F.when(F.bool_or(s == "contradicted"), "conflict").when(F.bool_or(s == "outdated"), "outdated").when(F.bool_and(s == "verified"), "verified").otherwise("unverified")
    return facts.groupBy(key).agg(state.alias("verification"), F.count("*").alias("n_facts"))


def warnings(facts: DataFrame, key: str) -> DataFrame:
    """Counts of contradicted, outdated and unchecked facts of each key."""
    s = F.col("status")
    return facts.groupBy(key).agg(F.count_if(s == "contradicted").alias("contradicted"), F.count_if(s == "outdated").alias("outdated"), F.count_if(s.isin("unchecked", "unverifiable")).alias("unchecked"))


def retained(events: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """Events not older than the cutoff; the filter reaches the scan."""
    return events.where(F.col(ts) >= cutoff)


def use_counts(events: DataFrame, key: str, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy(key).agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used"))


def with_versions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def first_of_title(rows: DataFrame, key: str, title: Column) -> DataFrame:
    """key, duplicate_of: the smallest key with the same title key, null for the first itself."""
    keyed = rows.select(key, title_key(title).alias("t"))
    first = keyed.groupBy("t").agg(F.min(key).alias("first"))
    return keyed.join(first, "t").select(key, F.when(F.col("first") < F.col(key), F.col("first")).alias("duplicate_of"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins by key: changes replace rows of the same key, others stay."""
    both = current.withColumn("_o", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.select(*current.columns, F.col(order).alias("_o")))
    row = F.struct(*current.columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct(F.col("_o").isNotNull(), "_o")).alias("x")).select("x.*")


def new_versions(current: DataFrame, edits: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Edits whose canonical content differs from the current one, as the next version."""
    mark = lambda: F.sha2(F.to_json(F.struct(*[F.trim(F.col(c)).alias(c) for c in content])), 256)
    now = current.select(key, "version", mark().alias("_now"))
    return edits.withColumn("_new", mark()).join(now, key).where("_new <> _now").withColumn("version", F.col("version") + 1).drop("_new", "_now")


def pruned(cache: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return cache.join(keep.select(key).distinct(), key, "left_semi")


def add_missing(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Names without a category of the same name, in any case, each once."""
    have = categories.select(F.lower("name").alias("k"))
    return names.select("name", F.lower("name").alias("k")).join(have, "k", "left_anti").groupBy("k").agg(F.min("name").alias("name")).select("name")
