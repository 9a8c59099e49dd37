"""Questions by topic on our own cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify
from tessella.operators import intents, questions

CASES = [
    ("Hi team, thanks in advance", []),
    ("Hello Maria. Best regards, Tom", []),
    ("Where is my payout?", [("Where is my payout?", "withdrawal_status")]),
    ("My payout is pending for days and also when do I get the bonus?", [("My payout is pending for days", "withdrawal_status"), ("when do I get the bonus?", "bonus")]),
    ("My payout is late. Can you check?", [("My payout is late. Can you check?", "withdrawal_status")]),
    ("I wrote you before. It was about a bonus. Could you look?", [("I wrote you before. It was about a bonus. Could you look?", "bonus")]),
    ("I like the bonus. I like the payout.", []),
    ("The site has an error.", [("The site has an error.", "technical")]),
    ("My bonus is missing.", [("My bonus is missing.", "bonus")]),
    ("1) Where is my bonus?\n2) Where is my promo?", [("Where is my bonus?", "bonus"), ("Where is my promo?", "bonus")]),
    ("Where is the bonus? Is the promo still valid?", [("Where is the bonus? Is the promo still valid?", "bonus")]),
    ("Is it 2.5 percent, e.g. for a bonus of www.x.org?", [("Is it 2.5 percent, e.g. for a bonus of www.x.org?", "bonus")]),
    ("What now?", [("What now?", None)]),
    ("also, please help. btw the deposit was fine", [("also, please help.", None), ("btw the deposit was fine", "deposit_missing")]),
    ("Where is my bonus? Thanks for your help, Ann", [("Where is my bonus?", "bonus")]),
    ("??? ... !!!", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_split(text, want):
    got = questions.split(text)
    assert [(q, i) for q, i, _, _ in got] == want
    assert all(" ".join(text[s:e].split()) == q for q, _, s, e in got)


def test_bounds():
    many = "Where is my payout? Where is my bonus? " * 300
    assert len(questions.split(many)) == 6 and len(questions.split(many, clauses=300, most=1000)) == 300 and len(questions.split(many, 10**6, 10**6)) == 600


def test_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    asked = questions.question_rows(df, ["id"], F.col("text"))
    assert [(r["id"], r["place"], r["question"], r["intent"]) for r in asked.orderBy("id", "place").collect()] == [(i, n, q, k) for i, (_, qs) in enumerate(CASES) for n, (q, k) in enumerate(qs, 1)]
    assert {(r["id"], r["intent"]): r["n_questions"] for r in intents.question_counts(asked, ["id"]).collect()}[9, "bonus"] == 2


def test_scores_are_those_of_the_column(spark):
    texts = ["payout and deposit", "My BONUS, promo  and free spins", "nothing", "", "‘top up’ of the payout, cash out"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.element_at(classify.intent_scores(F.col("t")), 1).alias("x")).collect():
        assert questions.scored(r["t"]) == ((None, 0.0) if r["x"]["intent"] == "general" else (r["x"]["intent"], r["x"]["score"]))
