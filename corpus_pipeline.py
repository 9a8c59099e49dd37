"""A pipeline from raw documents to packed training sequences, of five of the training-data operators.

1. Language ID rejects documents whose text is null or has no letter, and fills in a missing lang.
2. Line dedup drops lines that repeat an earlier one, and documents of which nothing is left.
3. MinHash near-dedup keeps one document, that with the smallest doc_id, of each group.
4. Suffix-array dedup cuts the bytes that repeated 200-byte strings cover, and drops documents of which nothing is left.
5. Best-fit packing returns the pieces of what is left, with their places in sequences.

Cases: as in the operators' own docstrings. In short: a null or empty text is rejected by the first stage; of repeated rows the one with the smallest
number stays; rows that share a doc_id, or have none, are documents of their own; very long texts pass whole; an empty table gives an empty
result; without any lang no document is rejected for it; extra columns, whatever their names, are handed on up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import language_id, line_dedup, minhash, packing, suffix_dedup
from tessella.llm.common import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", lambda spark, docs, sf_dir: language_id.keep_identified(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: line_dedup.drop_repeated_lines(docs)),
    ("minhash_near_dedup", lambda spark, docs, sf_dir: minhash.keep_one_each(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: suffix_dedup.drop_repeated(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: packing.op3_best_fit_packing(docs)),
]

#: Language ID, MinHash and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's table is written and read again, and deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
