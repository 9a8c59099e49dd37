"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import divergence, embedding_dedup, fingerprint, language_id, line_dedup, merkle, minhash, packing, quality, sentencepiece_fst, suffix_dedup, toxicity, warc
from tessella.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(table(spark, sf_dir, name))

    return {
        "op1_language_id": over("documents", language_id.op1_language_id),
        "op2_sentencepiece": over("documents", sentencepiece_fst.op2_sentencepiece),
        "op3_best_fit_packing": over("documents", packing.op3_best_fit_packing),
        "op4_suffix_array_dedup": over("documents", suffix_dedup.op4_suffix_array_dedup),
        "op5_fingerprints": over("documents", fingerprint.op5_fingerprints),
        "op6_minhash_near_dedup": over("documents", minhash.op6_minhash_near_dedup),
        "op7_embedding_near_dedup": over("embeddings", embedding_dedup.op7_embedding_near_dedup),
        "op8_quality": over("documents", quality.op8_quality),
        "op9_warc": over("pages", warc.op9_warc),
        "op10_line_dedup": over("documents", line_dedup.op10_line_dedup),
        "op11_source_divergence": over("documents", divergence.op11_source_divergence),
        "op12_toxicity": lambda spark, sf_dir: toxicity.op12_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op13_merkle": over("documents", merkle.op13_merkle),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": divergence.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
