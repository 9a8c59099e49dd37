"""The quality classifier learns from every distinct text, and its floor is exact."""

import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tessella.llm")

from pyspark.sql import functions as F  # noqa: E402

from tessella.llm import quality  # noqa: E402


def averaged(texts, groups):
    """Weights from {text: (h, p)}, group by group in plain Python."""
    dealt = defaultdict(list)
    for text, (h, p) in texts.items():
        dealt[h % groups].append((h, text, p))
    return sum(quality.learned([t for _, t, _ in sorted(g)], [p for _, _, p in sorted(g)], quality.BITS, 3, 0.5) * len(g) for g in dealt.values()) / len(texts)


def test_all_texts_are_learned_from(spark):
    """More texts than were once sampled, one of them repeated: weights and floor against plain Python over all."""
    rng = random.Random(21)
    bank = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    line = lambda i: " ".join(rng.choice(bank) for _ in range(rng.randint(3, 12))) + (". " if i % 3 else f" %%% {i} ") + rng.choice(bank).upper() * (i % 5 == 0)
    rows = [(i, line(i)) for i in range(22_000)]
    rows += [(30_000 + i, rows[7][1]) for i in range(500)] + [(40_000, None), (40_001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, weights, floor = quality.fit(docs)
    names = list(model.names)
    ms = docs.distinct().select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*[c.alias(n) for n, c in quality.measures(F.col("text")).items()]).alias("m"))
    votes = quality.votes({n: F.col(f"m.{n}") for n in quality.measures(F.col("text"))})
    pdf = ms.select("text", F.xxhash64("text").alias("h"), *[c.cast("double").alias(n) for n, c in votes.items()]).toPandas().drop_duplicates("text")
    p = model.posterior(pdf[names].to_numpy(float))
    texts = dict(zip(pdf["text"], zip(pdf["h"].tolist(), p.tolist(), strict=True), strict=True))
    assert len(texts) > 20_000
    assert np.allclose(weights, averaged(texts, -(-len(texts) // 2_500)), atol=1e-6)
    out = {r["text"] or "": (r["quality_score"], r["kept"]) for r in quality.op8_quality(docs).join(docs, "doc_id").collect()}
    scores = [out[t][0] for t in texts]
    assert abs(floor - np.quantile(scores, 1 - model.prior, method="lower")) < 1e-9
    assert sum(not kept for _, kept in out.values()) == np.searchsorted(np.sort(scores), floor - 1e-12)


def test_weights_of_many_groups(spark):
    """Averages in rounds are the average over all groups."""
    rng = random.Random(22)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(9)) + f" {i}", rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, p double")
    hashed = {r["text"]: (r["h"], r["p"]) for r in df.select("text", "p", F.xxhash64("text").alias("h")).collect()}
    assert np.allclose(quality.train_scorer(df, groups=150), averaged(hashed, 150))


def test_exact_floor(spark):
    rng = np.random.default_rng(23)
    values = np.concatenate((rng.random(300), rng.random(200) * 1e-9 + 0.5, np.zeros(20), np.full(30, 0.25), [1.0, 5e-324]))
    df = spark.createDataFrame([(int(b),) for b in values.view(np.int64)], "bits long")
    for share in (0.0, 0.02, 0.05, 0.3, 0.611, 0.98, 1.0):
        assert quality.at_share(df, share) == np.quantile(values, share, method="lower")
    assert quality.at_share(df.where("false"), 0.3) == 0.0
