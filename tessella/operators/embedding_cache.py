"""Vectors of texts, made once for each content and model: a cache table beside the library, its misses by an anti-join.

The cache is a Parquet table (model, mark, vector), partitioned by model; mark is the digest of the text. Entries of another model or dimension, and
null ones, are misses. Null texts count as empty. Rows keep their own columns; equal texts share a vector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.features import featured, kept

SCHEMA = "mark string, vector array<float>, model string"
#: Makes vectors: rows (mark, text) to rows (mark, vector).
Embedder = Callable[[DataFrame], DataFrame]


def hashed(rows: DataFrame) -> DataFrame:
    """The embedder by feature hashing."""
    return featured(rows, ["mark"], {"text": F.col("text")}).select("mark", F.col("text_vector").cast("array<float>").alias("vector"))


def entries(spark: SparkSession, folder: str, model: str, dim: int) -> DataFrame:
    """mark, vector of a model's usable entries, one for each mark; the filter on the model prunes the table's partitions."""
    try:
        spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "mark string, vector array<float>")
    found = spark.read.schema(SCHEMA).parquet(folder).where((F.col("model") == model) & (F.size("vector") == dim))
    return found.groupBy("mark").agg(F.min("vector").alias("vector"))


def embedded(df: DataFrame, text: Column, folder: str, model: str, dim: int, embed: Embedder = hashed) -> tuple[DataFrame, int]:
    """df with a column vector, and how many texts had to be embedded. What was missing is appended to the cache; a text whose vector has another dimension stays without."""
    spark = df.sparkSession
    marked = df.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_mark", F.sha2("_text", 256))
    cache = kept(entries(spark, folder, model, dim))
    missing = marked.groupBy(F.col("_mark").alias("mark")).agg(F.first("_text").alias("text")).join(cache, "mark", "left_anti")
    made = kept(embed(missing).select("mark", F.col("vector").cast("array<float>").alias("vector")))
    n = made.count()
    if n:
        made.where(F.size("vector") == dim).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(folder)
    known = cache.unionByName(made.where(F.size("vector") == dim)).withColumnRenamed("mark", "_mark")
    return marked.join(known, "_mark", "left").drop("_mark", "_text"), n


def pruned(spark: SparkSession, folder: str, model: str, dim: int, df: DataFrame, text: Column) -> DataFrame:
    """Entries of a model whose text is still in use."""
    return entries(spark, folder, model, dim).join(df.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("mark")).distinct(), "mark", "left_semi")
