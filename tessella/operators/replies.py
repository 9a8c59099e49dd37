"""Replies put together from several macros, drafts, warnings and pseudonyms, as operations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import signals

#: Words from which on a line that repeats an earlier one of the same reply is left out.
REPEAT_WORDS = 4


def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reply: the bodies (slot, body) of each message as one text.

    The first greeting and the last closing stay; a line of REPEAT_WORDS words and more stays where it comes first, whatever its case and spacing.
    """
    opened = rows.select(*keys, "slot", signals.split_greeting(F.col("body")).alias("g"))
    parts = opened.select(*keys, "slot", "g.greeting", signals.split_closing(F.col("g.rest")).alias("c")).select(*keys, "slot", "greeting", F.col("c.rest").alias("rest"), "c.closing")
    ends = parts.groupBy(*keys).agg(F.min_by("greeting", F.when(F.col("greeting") != "", F.col("slot"))).alias("greeting"), F.max_by("closing", F.when(F.col("closing") != "", F.col("slot"))).alias("closing"))
    lines = parts.select(*keys, "slot", F.posexplode(F.split("rest", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    mark = F.lower(F.trim(F.regexp_replace("line", r"\s+", " ")))
    long = F.size(F.split(mark, " ")) >= REPEAT_WORDS
    turn = F.row_number().over(Window.partitionBy(*keys, "mark").orderBy("slot", "pos"))
    kept = lines.withColumn("mark", mark).withColumn("turn", turn).where(~long | (F.col("turn") == 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "pos", "line"))), lambda x: x["line"]), "\n")
    middle = kept.groupBy(*keys).agg(text.alias("middle"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return ends.join(middle, keys, "left").select(*keys, F.concat_ws("\n\n", filled("greeting"), filled("middle"), filled("closing")).alias("reply"))


def drafted(questions: DataFrame, keys: list[str], user: Column) -> DataFrame:
    """keys, draft: a skeleton reply with a placeholder for each question (place, text)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.concat(F.lit("[ENTER ANSWER: "), x["text"], F.lit("]")))
    made = questions.groupBy(*keys).agg(listed.alias("lines"), F.first(user, ignorenulls=True).alias("user"))
    return made.select(*keys, F.concat(F.lit("Hi "), F.coalesce("user", F.lit("there")), F.lit(",\n\n"), F.array_join("lines", "\n")).alias("draft"))


def warnings(risk: Column, foreign: Column, verification: Column) -> Column:
    """What whoever sends a reply has to know: risk signals, another language, macros whose facts aren't in order."""
    return F.array_compact(F.array(F.when(F.size(risk) > 0, "responsible gambling"), F.when(foreign, "not in English"), F.when(verification.isin("outdated", "conflict"), F.concat(F.lit("macro is "), verification))))


def restored(replies: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reply with the tokens (keys, token, value) of each message replaced by their values, the longest token first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("n"), F.col("token"), F.col("value"))))
    of = tokens.groupBy(*keys).agg(listed.alias("pairs"))
    put = F.aggregate("pairs", F.col("reply"), lambda text, x: F.replace(text, x["token"], x["value"]))
    return replies.join(of, keys, "left").select(*keys, F.when(F.col("pairs").isNull(), F.col("reply")).otherwise(put).alias("reply"))
