"""Imports that write: what each item of a batch does, given the items before it, and the library's tables after all of it, committed as a whole.

Tables: macros (macro_id, title, current_version, archived, is_favorite), versions (macro_id, version, title, body), facts (macro_id, fact_key, value),
items (pos, title, body, archived, is_favorite, facts: array of (fact_key, value)). Positions are whole numbers and differ; null texts count as empty,
null flags as false. Items of one title may be any share of the batch: what an item takes from those before it is carried over blocks of positions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import title_key
from tessella.operators.features import kept
from tessella.operators.ordering import WIDTH, carried, running

POLICIES = ("skip", "new_version", "create_copy")
TABLES = ("macros", "versions", "facts")
COPY = " (copy)"


def _mark(title: Column, body: Column) -> Column:
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.sha2(F.to_json(F.struct(trimmed(title).alias("t"), trimmed(body).alias("b"))), 256)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", title_key(F.coalesce("title", F.lit("")))).withColumn("mark", _mark(F.col("title"), F.col("body")))


def planned(macros: DataFrame, versions: DataFrame, items: DataFrame, policy: str, width: int = WIDTH) -> DataFrame:
    """Items with action (create, update, skip), macro_id (that of the macro they make or change; null if skipped), version and changed.

    A live item is a duplicate if a live macro has its title key or an earlier live item of the batch made one. Under skip it is left out; under
    create_copy it becomes a macro of its own, with a title that says so (a copy isn't looked up by its new title within the batch); under
    new_version it updates the macro, and is a version only if it differs from what the macro holds by then. An archived item is restored as archived,
    unless an archived macro or an earlier archived item has the same content. Of several live macros of a title the smallest id counts.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("archived", "is_favorite")}
    rows = _keyed(items.withColumns(flags))
    now = macros.select("macro_id", F.col("current_version").alias("version"), F.coalesce("archived", F.lit(False)).alias("archived")).join(versions, ["macro_id", "version"])
    now = _keyed(now)
    same = now.where("NOT archived").groupBy("k").agg(F.min_by(F.struct("macro_id", "version", "mark"), "macro_id").alias("same"))
    gone = now.where("archived").select("k", "mark").distinct()

    live = rows.where("NOT archived")
    first = live.groupBy("k").agg(F.min("pos").alias("first"))
    live = live.join(first.join(same, "k", "left"), "k")
    makes = F.col("same").isNull() & (F.col("pos") == F.col("first"))
    if policy == "new_version":
        live = carried(live, ["k"], "pos", "mark", width)
        live = live.withColumn("changed", F.coalesce(F.col("mark") != F.coalesce("before", "same.mark"), F.lit(True))).drop("before")
        live = running(live, ["k"], "pos", [], F.col("changed").cast("long"), width)
        live = live.withColumn("version", F.coalesce("same.version", F.lit(0)) + F.col("n")).drop("n").withColumn("action", F.when(makes, "create").otherwise("update"))
    else:
        live = live.withColumn("action", F.when(makes | F.lit(policy == "create_copy"), "create").otherwise("skip"))
        live = live.withColumn("changed", F.col("action") == "create").withColumn("version", F.when(F.col("changed"), F.lit(1)).cast("long"))
        live = live.withColumn("title", F.when(makes, F.col("title")).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit(COPY))))

    kept_away = rows.where("archived")
    once = kept_away.groupBy("k", "mark").agg(F.min("pos").alias("pos")).join(gone, ["k", "mark"], "left_anti").select("pos", F.lit(True).alias("_new"))
    kept_away = kept_away.join(once, "pos", "left").withColumn("action", F.when(F.col("_new"), "create").otherwise("skip")).drop("_new")
    kept_away = kept_away.withColumn("changed", F.col("action") == "create").withColumn("version", F.when(F.col("changed"), F.lit(1)).cast("long"))

    out = kept(live.unionByName(kept_away, allowMissingColumns=True))
    last = macros.agg(F.coalesce(F.max("macro_id"), F.lit(0)).alias("_last"))  # one row
    made = running(out.where("action = 'create'").select("pos"), [], "pos", [], F.lit(1), width).crossJoin(F.broadcast(last)).select("pos", (F.col("n") + F.col("_last")).alias("_id"))
    made = kept(made)
    of_title = out.where("action = 'create' AND NOT archived AND pos = first AND same IS NULL").select("k", "pos").join(made, "pos").select("k", F.col("_id").alias("_made"))
    out = out.join(made, "pos", "left").join(of_title, "k", "left")
    target = F.when(F.col("action") == "create", F.col("_id")).when(F.col("action") == "update", F.coalesce("same.macro_id", "_made"))
    return out.withColumn("macro_id", target).drop("k", "mark", "first", "same", "_id", "_made")


def applied(macros: DataFrame, versions: DataFrame, facts: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """The three tables after the plan: facts are those of the last item that gives any, a favourite stays one, titles are those of the last version."""
    done = plan.where("action <> 'skip'")
    made = done.where("changed").select("macro_id", "version", F.col("title"), F.col("body"))
    all_versions = versions.unionByName(made.select(*versions.columns))
    state = done.groupBy("macro_id").agg(F.max("version").alias("_v"), F.max_by("title", "pos").alias("_t"), F.bool_or("archived").alias("_a"), F.bool_or("is_favorite").alias("_f"))
    both = macros.select("macro_id", "title", "current_version", "archived", "is_favorite").join(state, "macro_id", "full_outer")
    all_macros = both.select(
        "macro_id", F.when(F.col("_v").isNotNull(), F.col("_t")).otherwise(F.col("title")).alias("title"), F.coalesce("_v", "current_version").alias("current_version"),
        F.coalesce("archived", "_a").alias("archived"), (F.coalesce("is_favorite", F.lit(False)) | F.coalesce("_f", F.lit(False))).alias("is_favorite"),
    )
    given = done.where(F.size(F.coalesce("facts", F.array().cast(plan.schema["facts"].dataType))) > 0).groupBy("macro_id").agg(F.max_by("facts", "pos").alias("_facts"))
    rest = facts.join(given.select("macro_id"), "macro_id", "left_anti")
    new = given.select("macro_id", F.inline("_facts"))
    return {"macros": all_macros, "versions": all_versions, "facts": rest.unionByName(new.select(*facts.columns))}


def committed(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables beside the current ones, then one row that names them: readers see all of a commit or nothing. Returns its number.

    A failed write leaves files that no commit names. Of two writers that began from the same commit the second fails.
    """
    n, path = latest(spark, folder)[0] + 1, f"{folder}/tables-{uuid.uuid4().hex}"
    for name in TABLES:
        tables[name].write.parquet(f"{path}/{name}")
    spark.createDataFrame([(path,)], "path string").write.mode("errorifexists").parquet(f"{folder}/commits/n={n}")
    return n


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """Number of the last commit, and its tables; 0 and none before the first."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.option("basePath", f"{folder}/commits").parquet(f"{folder}/commits").agg(F.max(F.struct("n", "path")).alias("x")).first()["x"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return (0, {}) if row is None else (row["n"], {t: spark.read.parquet(f"{row['path']}/{t}") for t in TABLES})


def import_items(spark: SparkSession, folder: str, items: DataFrame, policy: str) -> dict[str, int]:
    """Imports a batch into the library at a folder, all or nothing, and counts what it created, updated and skipped."""
    _, tables = latest(spark, folder)
    if not tables:
        raise ValueError("the folder holds no library yet: commit its tables first")
    plan = kept(planned(tables["macros"], tables["versions"], items, policy))
    counts = plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("create", "update", "skip")]).first().asDict()
    committed(spark, folder, applied(**tables, plan=plan))
    return counts
