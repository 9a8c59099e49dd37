"""Feature-hashed text vectors and cosine top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.features import featured


def hashed_features(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Sparse unit vectors (key, bucket, w) of texts: the non-zero places of the vectors that the ranker compares."""
    made = featured(df, [key], {"text": text}).select(key, "text_vector")
    length = F.sqrt(F.aggregate("text_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    places = F.filter(F.transform("text_vector", lambda x, i: F.struct(i.cast("long").alias("bucket"), x.alias("x"))), lambda p: p["x"] != 0)
    return made.select(key, length.alias("_length"), F.inline(places)).select(key, "bucket", (F.col("x") / F.col("_length")).alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _block(structs: pa.StructArray, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a block, from Arrow's own buffers."""
    flat = structs.field(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(structs), -1)
    return structs.field(key).to_numpy(zero_copy_only=False), x / np.linalg.norm(x, axis=1, keepdims=True)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """The k nearest rows by cosine for each row of a stated query set: query blocks against the whole table, as matrix products.

    Queries are dealt into blocks of bounded size; each block meets each partition of the table once, keeps its own k best
    there, and the partial lists are merged.
    """
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False)))
    queries, vectors = usable(queries), usable(vectors)  # null, empty and zero vectors, and such with null or infinite parts, have no cosine
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct(key, vector)).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ask, rows in zip(batch.column("q"), batch.column("rows"), strict=True):
                (ids, x), (other, y) = _block(ask.values, key, vector), _block(rows.values, key, vector)
                s = x @ y.T
                s[ids[:, None] == other[None, :]] = -2
                for i in range(len(ids)):
                    best = np.lexsort((other, -s[i]))[: k + 1]
                    best = best[s[i][best] > -2][:k]
                    yield pa.RecordBatch.from_pydict({key: pa.array(np.full(len(best), ids[i])), "other": pa.array(other[best]), "cosine": pa.array(s[i][best])})

    rows = vectors.withColumn("p", F.pmod(F.xxhash64(key), F.lit(max(1, -(-vectors.count() // block))))).groupBy("p").agg(F.collect_list(F.struct(key, vector)).alias("rows"))
    met = rows.crossJoin(q).select("q", "rows")  # blocks of the query set against blocks of the table
    part = met.mapInArrow(run, f"{key} long, other long, cosine double")
    from tessella.operators.lexical import top_k as best_of

    return best_of(part, [key], [F.desc("cosine"), F.asc("other")], k)
