"""Readers and writers of reply libraries: CSV, JSON, pasted text, raw bytes; validation into good rows and problems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessella.functions.text import title_key

#: Accepted names of each field, first one present wins; compared in lower case without space, _ and -. Files must be read alike.
FIELDS = {
    "title": ("title", "name", "macro", "macroname"),
    "body": ("body", "text", "content", "message", "reply", "template"),
    "category": ("category", "folder", "group"),
    "tags": ("tags", "labels"),
    "intents": ("intents", "intent"),
    "triggers": ("triggers", "examples", "examplequestions"),
    "notes": ("notes", "note", "internalnote"),
    "shortcut": ("shortcut", "code", "key"),
    "facts": ("facts",),
}
FACT = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("key", "statement", "value", "source", "status")]))
#: What an import refuses as a whole.
MAX_BYTES, MAX_ITEMS = 30 * 1024 * 1024, 20_000
LISTS = ("tags", "intents", "triggers")
LIMITS = {"title": 200, "body": 20_000, "category": 80, "notes": 2000, "shortcut": 40}
ITEM = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def detect_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab; comma wins ties."""
    return max(",;\t", key=lambda c: (line.count(c), c == ","))


def resolve(columns: list[str]) -> dict[str, str]:
    """Field -> column, by the accepted names."""
    plain = {c.lower().replace(" ", "").replace("_", "").replace("-", ""): c for c in reversed(columns)}
    return {field: plain[n] for field, names in FIELDS.items() for n in reversed(names) if n in plain}


def _fields(df: DataFrame) -> DataFrame:
    found = resolve(df.columns)
    return df.select(*[F.trim(F.col(f"`{found[f]}`").cast("string")).alias(f) if f in found else F.lit(None).cast("string").alias(f) for f in FIELDS])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """RFC 4180 with a header; the delimiter is read off the first line unless given."""
    if delimiter is None:
        lines = spark.read.text(path).where(F.trim("value") != "").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
        head = lines.orderBy("file_path", "file_block_start", "at").limit(1).collect()
        delimiter = detect_delimiter(head[0]["value"]) if head else ","
    return _fields(spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of items, an object with `macros`, or a single item."""
    df = spark.read.option("multiLine", True).json(path)
    if "macros" in df.columns:
        df = df.select(F.explode("macros").alias("m")).select("m.*")
    joined = [F.array_join(F.col(c), ",").alias(c) if isinstance(t.dataType, T.ArrayType) and isinstance(t.dataType.elementType, T.StringType) else F.col(f"`{c}`") for c, t in zip(df.columns, df.schema, strict=True)]
    return _fields(df.select(*joined))


def parse_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Pasted text: blocks between `---` lines, or from a `### ` heading on; the first line is the title, then `Key: value` lines, the rest is the body."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"\r\n?", "\n")
    blocks = texts.select(F.explode(F.split(clean, r"(?m)^\s*---\s*$|^(?=### )")).alias("b")).select(F.trim(F.regexp_replace("b", r"^\s+|\s+$", "")).alias("b")).where("b <> ''")
    title = F.regexp_replace(F.regexp_extract("b", r"^([^\n]*)", 1), r"^#+\s*", "")
    rest = F.regexp_replace("b", r"^[^\n]*\n?", "")
    head = F.regexp_extract(rest, r"(?i)^((?:(?:category|tags|intents|triggers|notes|shortcut|facts)\s*:[^\n]*(?:\n|$))*)", 1)
    value = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{k}\s*:([^\n]*)$", 1)), F.lit(""))
    body = F.regexp_replace(F.substring(rest, F.length(head) + 1, F.length(rest)), r"^\s+|\s+$", "")
    return blocks.select(F.trim(title).alias("title"), body.alias("body"), *[value(f).alias(f) for f in FIELDS if f not in ("title", "body")])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocks(spark.read.text(path, wholetext=True))


@pandas_udf(T.StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    """Text of raw files: UTF-16 by its mark, else UTF-8, else Windows-1252, which Spark's own decode doesn't offer."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return data.decode("utf-16", "replace")
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            return data.decode("cp1252", "replace")

    return content.map(one)


def clean_list(value: Column, most: int = 50) -> Column:
    """Items of a comma list: trimmed, without empty ones and repeats in other case, at most `most`."""
    items = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    once = F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)
    return F.slice(once, 1, most)


def validated(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with cleaned lists, and problems (title, problem): missing title or body, over-long fields."""
    missing = [F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f"missing {f}")) for f in ("title", "body")]
    long = [F.when(F.length(f) > n, F.lit(f"{f} is longer than {n} characters")) for f, n in LIMITS.items()]
    judged = items.withColumn("problems", F.array_compact(F.array(*missing, *long)))
    good = judged.where(F.size("problems") == 0).select(*[clean_list(F.col(f)).alias(f) if f in LISTS else F.col(f) for f in FIELDS])
    return good, judged.where(F.size("problems") > 0).select("title", F.explode("problems").alias("problem"))


def known_intents(values: Column, intents: dict[str, str]) -> Column:
    """A struct (known, unknown): ids of the intents that a list names by id or label, and what it names besides, at most five, as that is what a report shows."""
    from tessella.functions.text import slug as slugged

    plain = F.transform(values, lambda x: slugged(x))
    def named(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, label in intents.items():
            out = F.when((x == k) | (x == slugged(F.lit(label))), k).otherwise(out)
        return out

    found = F.transform(plain, named)
    unknown = F.filter(F.transform(values, lambda x, i: F.when(F.get(found, i).isNull(), x)), lambda x: x.isNotNull())
    return F.struct(F.array_distinct(F.array_compact(found)).alias("known"), F.slice(unknown, 1, 5).alias("unknown"))


def facts_of(items: DataFrame, key: str = "title") -> DataFrame:
    """Facts of items from their JSON: key, fact_key, statement, value, source, status; an array or a single object.

    A source that isn't a web address is dropped; a missing key is made of the statement; keys that repeat within an item get _2, _3 and so on.
    """
    from tessella.functions.text import slug

    one = F.from_json(F.concat(F.lit("["), F.col("facts"), F.lit("]")), FACT)
    parsed = F.when(F.startswith(F.ltrim("facts"), F.lit("[")), F.from_json("facts", FACT)).otherwise(one)
    each = items.where("facts IS NOT NULL").select(F.col(key), F.posexplode(parsed).alias("pos", "f")).where(F.coalesce(F.trim("f.statement"), F.lit("")) != "")
    named = each.withColumn("k", F.coalesce(F.nullif(F.trim("f.key"), F.lit("")), slug(F.col("f.statement"))))
    turn = F.row_number().over(Window.partitionBy(key, "k").orderBy("pos"))
    numbered = named.withColumn("turn", turn)
    return numbered.select(
        key, F.when(F.col("turn") > 1, F.concat("k", F.lit("_"), F.col("turn").cast("string"))).otherwise(F.col("k")).alias("fact_key"), F.trim("f.statement").alias("statement"), "f.value",
        F.when(F.col("f.source").rlike("(?i)^https?://"), F.col("f.source")).alias("source"), F.coalesce("f.status", F.lit("unchecked")).alias("status"),
    )


def parse_import(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Items and problems (title, problem) of a file of a kind: csv, json or text. Too large files, too many items and empty ones give no item and one problem."""
    readers = {"csv": read_csv, "json": read_json, "text": read_text}
    if kind not in readers:
        raise ValueError(f"unknown kind of import: {kind}")
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).collect()[0]["n"]
    items = readers[kind](spark, path)
    n = items.count() if 0 < size <= MAX_BYTES else 0
    refusal = f"larger than {MAX_BYTES} bytes" if size > MAX_BYTES else f"more than {MAX_ITEMS} items" if n > MAX_ITEMS else "no content" if n == 0 else None
    if refusal is None:
        return validated(items)
    good, problems = validated(items.limit(0))
    return good, problems.unionByName(spark.createDataFrame([(None, refusal)], "title string, problem string"))


def marked_duplicates(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds duplicate_of: the id of an existing row (id, title) with the same title key."""
    have = existing.groupBy(title_key(F.col("title")).alias("k")).agg(F.min("id").alias("duplicate_of"))
    return items.withColumn("k", title_key(F.col("title"))).join(have, "k", "left").drop("k")


def export_json(library: DataFrame, path: str) -> None:
    """One JSON object a line, which read_json and Spark's own reader take back."""
    library.write.mode("overwrite").json(path)


def export_rows(library: DataFrame, categories: DataFrame) -> DataFrame:
    """A JSON line for each row, with its category's name in place of the id."""
    named = library.join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left").drop("category_id")
    return named.select(F.to_json(F.struct(*sorted(named.columns))).alias("value"))
