"""Cases that earlier versions of the operators got wrong."""

import random

import numpy as np
import pytest

pytest.importorskip("tessella.llm")

from pyspark.sql import functions as F  # noqa: E402

from tessella.llm import embedding_dedup, language_id, quality  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int, rep int"


def test_languages_in_several_matrices(spark):
    """Parts of two languages each predict what one matrix of all predicts, with the same probability."""
    rng = random.Random(5)
    letters = {lang: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for lang in ("aa", "bb", "cc", "dd", "ee")}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(rng.randint(1, 4))), lang) for i in range(300) for lang in [rng.choice(sorted(letters))]]
    rows += [(900, None, "aa"), (901, "12", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where(~language_id.held_out())
    one = language_id.predict(docs, language_id.train(train)).collect()
    parts = language_id.train(train, languages=2)
    several = language_id.predict(docs, parts).collect()
    assert [m.languages for m in parts] == [("aa", "bb"), ("cc", "dd"), ("ee",)]
    assert [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in one] == [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in several]
    assert len({r["lang_pred"] for r in several}) == 6


def test_audited_links_are_linked(spark, monkeypatch):
    """Links that no search finds are linked where the audit finds them; copies count, and a class is asked for by any of its ids."""
    monkeypatch.setattr(embedding_dedup, "_searched", lambda pdf, threshold: pdf.iloc[:0].assign(a=0, b=0)[["a", "b"]])
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    near = (base + 0.01 * rng.normal(size=8)).tolist()
    rows = [(7, base.tolist(), 1, 0), (40, base.tolist(), 1, 0), (41, near, 1, 0)] + [(100 + i, rng.normal(size=8).tolist(), 1, 0) for i in range(30)]
    out = {r["vec_id"]: r for r in embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, VECTORS)).collect()}
    assert out[40]["n_links"] == out[7]["n_links"] == 2 and out[41]["n_links"] == 2
    assert out[40]["audited_links"] == out[40]["audited_held"] == 2 and out[40]["audited_found"] == 1
    assert {out[i]["component_id"] for i in (7, 40, 41)} == {7}


def test_quality_floor(spark):
    """As many are dropped as the labellers hold for bad, and these are the bad ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = lambda: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.randint(6, 12)))
    bad = lambda: " ".join(word().upper() + rng.choice(["%%%", "$$$!", "###"]) for _ in range(rng.randint(20, 60)))
    rows = [(i, bad() if i % 6 == 0 else good()) for i in range(600)]
    out = quality.op8_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wrong = [r["doc_id"] for r in out if r["kept"] == (r["doc_id"] % 6 == 0)]
    assert len(wrong) <= 6
    alike = spark.createDataFrame([(i, "One good line of words that is always the same, and ends here.") for i in range(50)], "doc_id long, text string")
    assert quality.op8_quality(alike).where("kept").count() == 50


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 5), (2, [1.0, 0.001], 1, 5), (None, None, None, None)]
    names = "vec_id long, embedding array<double>, label int, component int"
    out = embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, names).withColumns({c: F.lit(9) for c in ("rep", "vec", "n", "a", "b", "cell", "home", "ask")}))
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in out.collect()) == [(0, 0), (1, 1), (2, 1)]
