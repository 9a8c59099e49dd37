"""Helpers shared by the training-data operators: shared scratch tables, Arrow batches, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts lineage, survives a lost executor.

    Spark is told to delete the shuffle files of the write once it has ended; nothing reads them after it.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds _row, a unique number of each row: the key where keys are unique and not null.

    Else the table is written once with numbers of its own, so that they are the same whenever it is read.
    """
    odd = docs.groupBy(F.col(key).cast("long").alias("_row")).agg(F.count("*").alias("c")).where("c > 1 OR _row IS NULL")
    if odd.isEmpty():
        return docs.withColumn("_row", F.col(key).cast("long"))
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, _key, text and _rest, a struct of all other columns: no name of the caller's can clash with one of ours."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    return with_rows(docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("text"), rest.alias("_rest")), "_key")


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The caller's columns again, some of them with new values; text is rows' own."""
    new = {"text": F.col("text")} | new
    return rows.select(*[(new[c] if c in new else F.col("_rest").getField(c)).alias(c) for c in columns])


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tessella-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes) for runs of rows of about CHUNK_BYTES; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (node long, component long), component = smallest node.

    Every round lets each node hook onto its smallest neighbour and renames labels and edges by the hooks; the edges that
    are left shrink until there are none. A star takes one round. All state is in tables of the shared folder.
    Self loops, repeated edges and an empty list are fine. Null ends are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    left = materialise(pairs.distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "hook")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            to = hook.select(F.col("u").alias("component"), F.col("p").alias("to"))
            labels = materialise(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = left.where("u <> v").join(hook.select("u", F.col("p").alias("pu")), "u").join(hook.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        new = materialise(ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(left)
        left = new
    return labels
