"""Score arithmetic of the hybrid ranker, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and curves that scores must use to be comparable.
SEMANTIC, LEXICAL, INTENT, USAGE = 0.42, 0.30, 0.22, 0.06
CALIBRATION = {"builtin": (0.08, 0.75), "transformers": (0.45, 0.85), "ollama": (0.40, 0.82)}
BODY_FACTOR, LEXICAL_SCALE = 0.85, 60.0
MIDPOINT, SLOPE = 0.45, 6.5
PRODUCT_MISMATCH, RESOLVED = 0.5, 0.7
WANTED_MIN, QUESTION_FLOOR, RELATED_FACTOR = 0.35, 0.5, 0.5
NO_MATCH_BELOW = 45


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, as floor(x * 10**digits + 0.5) / 10**digits."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def calibrated(cosine: Column, provider: str = "builtin") -> Column:
    lo, hi = CALIBRATION[provider]
    return unit((cosine - lo) / (hi - lo))


def raw_semantic(head: Column, body: Column) -> Column:
    return F.greatest(head, body * BODY_FACTOR)


def lexical(bm25: Column, best: Column) -> Column:
    return F.when((best <= 0) | (bm25 <= 0), 0.0).otherwise(unit(bm25 / best) * (1 - F.exp(-best / LEXICAL_SCALE)))


def usage(count: Column, most: Column, favourite: Column) -> Column:
    used = F.when(most > 0, F.log1p(F.greatest(count, F.lit(0)).cast("double")) / F.log1p(most.cast("double"))).otherwise(0.0)
    return unit(used * 0.6 + F.when(favourite, 0.4).otherwise(0.0))


def combined(semantic: Column, lex: Column, intent: Column, use: Column) -> Column:
    """Weighted sum; without a semantic score (null) the other weights are scaled to one."""
    rest = lex * LEXICAL + intent * INTENT + use * USAGE
    return F.when(semantic.isNull(), rest / (LEXICAL + INTENT + USAGE)).otherwise(semantic * SEMANTIC + rest)


def relevance(product_mismatch: Column, resolved: Column) -> Column:
    return F.when(product_mismatch, PRODUCT_MISMATCH).otherwise(1.0) * F.when(resolved, RESOLVED).otherwise(1.0)


def confidence(score: Column) -> Column:
    return F.floor(100 / (1 + F.exp((score - MIDPOINT) * -SLOPE)) + 0.5).cast("long")
