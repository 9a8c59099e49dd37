"""Issues of replies, in our own cases."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import grounding

CASES = [
    ("It takes 24 hours.", ["Ready within 24h."], set()),
    ("It takes 48 hours.", ["Ready within 24h.", "We have 48 offices."], {("unsupported_number", "48", "hour")}),
    ("You get $1,500.", ["The limit is 1500 USD, or 1.5k dollars."], set()),
    ("You get 1.5k dollars.", ["$1,500"], set()),
    ("A fee of 5 % applies.", ["A fee of 4 percent applies."], {("unsupported_number", "5", "percent")}),
    ("Between 3-5 business days.", ["three to five days"], set()),
    ("Between 3 and 6 days.", ["3 days"], {("unsupported_number", "6", "day")}),
    ("Room 77, step 3.", ["none"], {("unsupported_number", "77", None)}),
    ("Room 77.", ["77 hours"], set()),
    ("1. First\n2. Second", ["none"], set()),
    ("See https://www.help.example/a/ and https://help.example/b", ["https://help.example/a/deep?x=1"], {("unsupported_url", "help.example/b", None)}),
    ("Write to Help@Example.org or new@example.org", ["help@example.org"], {("unsupported_url", "new@example.org", None)}),
    ("We guarantee a payout.", ["policy:We cannot guarantee anything."], {("promise", "guarantee", None)}),
    ("We guarantee a payout.", ["policy:We guarantee it."], set()),
    ("We guarantee a payout.", ["Can you guarantee it?"], {("promise", "guarantee", None)}),
    ("We can't guarantee a payout.", [], set()),
    ("Dear [ENTER NAME], hello", ["[ENTER NAME]"], {("placeholder_left", "[ENTER NAME]", None)}),
    (None, ["10 days"], set()),
    ("", [None], set()),
    ("It is 10 days.", [], {("unsupported_number", "10", "day")}),
]


@pytest.fixture(scope="module")
def found(spark):
    replies = spark.createDataFrame([(i, reply) for i, (reply, _, _) in enumerate(CASES)], "id long, text string")
    sources = spark.createDataFrame([(i, (s or "").removeprefix("policy:") if s is not None else None, (s or "").startswith("policy:")) for i, (_, ss, _) in enumerate(CASES) for s in ss], "id long, text string, policy boolean")
    out = {}
    for r in grounding.issues(replies, sources, ["id"]).collect():
        out.setdefault(r["id"], set()).add((r["kind"], r["value"], r["unit"]))
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_issues(found, case):
    assert found.get(case, set()) == CASES[case][2]


def test_quantities(spark):
    df = spark.createDataFrame([("From $2k to €3, then two free spins, v 1,000.50 gbp and 007",)], "t string")
    got = [(c["value"], c["unit"]) for c in df.select(grounding.quantities(F.col("t")).alias("x")).first()["x"]]
    assert got == [("2000", "usd"), ("3", "eur"), ("2", "spin"), ("1000.5", "gbp"), ("7", None)]
