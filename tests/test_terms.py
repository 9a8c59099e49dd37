"""Generic words, keywords, answered questions and clauses on small cases."""

import random

from pyspark.sql import functions as F

from tessella.functions import signals
from tessella.operators import lexical, terms


def clause(spark, text, question=False):
    df = spark.createDataFrame([(text, question)], "text string, question boolean")
    return df.select(signals.is_resolved(F.struct("text", "question")).alias("x")).first()["x"]


def test_clauses(spark):
    df = spark.createDataFrame([("My deposit arrived but where is my bonus? Ok, thanks!",), (None,), ("...",), ("one\ntwo; three",)], "t string")
    out = [[(c["text"], c["question"]) for c in r["x"]] for r in df.select(signals.clauses(F.col("t")).alias("x")).collect()]
    assert out == [[("My deposit arrived", True), ("where is my bonus", True), ("Ok", False), ("thanks", False)], [], [], [("one", False), ("two", False), ("three", False)]]


def test_evidence(spark):
    for text, there in (("my deposit arrived", True), ("I got my payout", True), ("the deposit hasn't arrived", False), ("it didn’t go through, nothing received", False), ("has my deposit arrived", False), ("deposit", False), ("it still shows as received", False), ("the deposit cleared and came through", True), (None, False)):
        assert clause(spark, text) == there, text
    assert clause(spark, "my deposit arrived", True) is False


def test_keywords(spark):
    rows = [(i, t) for i, t in enumerate(["hello payout payout late", "hello bonus", "hello", None, "", "hello refund of Payout please"])]
    df = spark.createDataFrame(rows, "id long, t string")
    assert {r["token"] for r in terms.generic_words(df, F.col("t"), 0.5).collect()} == {"hello"}
    got = {r["id"]: r["keywords"] for r in terms.keywords(df, ["id"], F.col("t"), F.array(F.lit("Refund")), share=0.5, most=2).collect()}
    assert got == {0: ["payout", "late"], 1: ["bonus"], 5: ["payout", "please"]}
    assert {r["id"]: r["terms"] for r in terms.content_terms(df, ["id"], F.col("t"), share=0.5).collect()} == {0: ["late", "payout"], 1: ["bonus"], 5: ["payout", "pleas", "refund"]}


def test_answered(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    questions = [(i, rng.sample(words, rng.randint(0, 7)) or None) for i in range(50)] + [(90, ["only"]), (91, ["w1", "w1", "w2"])]
    heads = [(i, rng.sample(words, rng.randint(0, 12)) + ["common"]) for i in range(80)] + [(99, None), (98, [])]
    got = {(r["q"], r["h"], r["shared"], r["n"]) for r in terms.answered(spark.createDataFrame(questions, "q long, terms array<string>"), spark.createDataFrame(heads, "h long, terms array<string>"), ["q"], "h").collect()}
    want = {(q, h, len(set(a) & set(b)), len(set(a))) for q, a in questions for h, b in heads if a and b and len(set(a) & set(b)) >= 0.5 * len(set(a))}
    assert got == want and len(want) > 100


def test_messages_with_the_same_terms_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ALIKE", 3)
    macros = spark.createDataFrame([(1, "red wide widget", "economy"), (2, "blue widgets", "economical red"), (3, "green", "brand")], "id long, title string, tags string")
    index = lexical.field_postings(macros, "id", {"title": F.col("title"), "tags": F.col("tags")})
    asked = spark.createDataFrame([(k, t) for k in range(10) for t in (("red", "widg") if k % 3 else ("econom", "brand"))], "k long, term string")
    found = lexical.field_scores(index, asked, "id", ["k"])
    alone = lexical._field_scores(index, asked, "id", ["k"], lexical.BOOSTS)
    whole = lambda df: sorted((r["k"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert whole(found) == whole(alone) and len(whole(found)) > 10
    # what is scored is a row for each set of terms, not for each message
    seen = []
    monkeypatch.setattr(lexical, "_field_scores", lambda index, queries, *a: seen.append(queries.count()) or alone.withColumnRenamed("k", "_set"))
    lexical.field_scores(index, asked, "id", ["k"])
    assert seen == [4]
