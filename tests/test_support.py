"""Importers, entities and text signals on small cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import signals, text
from tessella.operators import catalogue, entities, intents, vectors
from tessella.sources import importer


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()["x"]


def test_import_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Macro Name,Template,Example Questions,Internal Note,Code\nPayout,"Hi, it is on its way",when; how,internal,po\n,no title,,,\n')
    good, problems = importer.parse_import(spark, str(tmp_path / "a.csv"), "csv")
    row = good.first()
    assert (row["title"], row["body"], row["triggers"], row["notes"], row["shortcut"]) == ("Payout", "Hi, it is on its way", ["when", "how"], "internal", "po")
    assert [r["problem"] for r in problems.collect()] == ["missing title"]


def test_import_refuses(spark, tmp_path, monkeypatch):
    (tmp_path / "e.txt").write_text("")
    assert [r["problem"] for r in importer.parse_import(spark, str(tmp_path / "e.txt"), "text")[1].collect()] == ["no content"]
    (tmp_path / "t.txt").write_text("First\nCategory: Money\nBody one\n### Second\nBody two\n---\nThird\nfacts: []\nBody three")
    good, problems = importer.parse_import(spark, str(tmp_path / "t.txt"), "text")
    assert [(r["title"], r["category"], r["body"]) for r in good.orderBy("title").collect()] == [("First", "Money", "Body one"), ("Second", None, "Body two"), ("Third", None, "Body three")]
    monkeypatch.setattr(importer, "MAX_ITEMS", 2)
    good, problems = importer.parse_import(spark, str(tmp_path / "t.txt"), "text")
    assert good.count() == 0 and [r["problem"] for r in problems.collect()] == ["more than 2 items"]
    with pytest.raises(ValueError):
        importer.parse_import(spark, "x", "xml")


def test_import_facts_and_intents(spark):
    items = spark.createDataFrame([("A", '[{"statement": "Fee is 1 %", "source": "ftp://x"}, {"key": "fee_is_1", "statement": "Again"}]'), ("B", '{"statement": "Limit", "source": "https://x", "status": "verified"}'), ("C", None)], "title string, facts string")
    assert [tuple(r) for r in importer.facts_of(items).orderBy("title", "fact_key").collect()] == [("A", "fee_is_1", "Fee is 1 %", None, None, "unchecked"), ("A", "fee_is_1_2", "Again", None, None, "unchecked"), ("B", "limit", "Limit", None, "https://x", "verified")]
    found = spark.range(1).select(importer.known_intents(F.array(*[F.lit(x) for x in ("Missing deposit", "bonus", "???")]), {"deposit_missing": "Missing deposit", "bonus": "Bonus"}).alias("x")).first()["x"]
    assert (found["known"], found["unknown"]) == (["deposit_missing", "bonus"], ["???"])


def test_digit_runs():
    kinds = lambda t: [(k, v) for k, v, *_ in entities.spans(t)]
    assert kinds("card 4111 1111 1111 1111 ok") == [("card", "4111 1111 1111 1111")]
    assert kinds("order 4111 1111 1111 1112") == []  # wrong check digit, and no sign of a phone
    assert kinds("call me at (040) 123-4567 now") == [("phone", "040) 123-4567")]
    assert kinds("+44 20 7946 0958") == [("phone", "+44 20 7946 0958")] and kinds("12345678") == []
    assert kinds("DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("bet #123456 for Gold II, username is bob_7") == [("bet_id", "#123456"), ("vip_rank", "Gold II"), ("username", "bob_7")]


def test_personal_parts(spark):
    df = spark.createDataFrame([(1, "no digits here"), (2, "mail a@b.co and a@b.co"), (3, None)], "id long, text string")
    out = {r["id"]: (r["n_personal"], r["masked"]) for r in entities.personal_parts(df, "id", F.col("text")).collect()}
    assert out == {1: (0, "no digits here"), 2: (2, "mail [EMAIL_1] and [EMAIL_1]"), 3: (0, None)}


def test_numbers(spark):
    for written, value in (("1,500.50", 1500.5), ("1.500,50", 1500.5), ("2k", 2000.0), ("12,5", 12.5), ("1 000", 1000.0), ("x", None)):
        assert one(spark, signals.normal_number(F.col("v0")), written) == value


def test_reply_texts(spark):
    assert one(spark, text.render(F.col("v0"), {"a": F.lit("1")}), "{{a}} {{b|two}} {{ c_d }}") == "1 two [ENTER C D]"
    assert one(spark, text.slug(F.col("v0")), "Straße Łódź – Øre") == "strasse_lodz_ore"
    assert one(spark, signals.native_variables(F.col("v0")), '{{ first_name | fallback: "you" }} {{name}}') == "{{user|you}} {{user}}"
    assert one(spark, signals.tidy(F.col("v0")), "a \r\nb\n\n\n\nc ") == "a\nb\n\nc"
    assert one(spark, signals.fnv1a(F.col("v0")), "foobar") == 0xBF9CF968
    assert one(spark, signals.summary(F.col("v0")), "Hi {{user}},\n you") == "Hi , you"


def test_natural_titles(spark):
    titles = ["á 1", "A 2", "Ä 10", "a 0011", "a 999999999999999999999999", "A 1000000000000000000000000", "b", "ß 1", "ST 3", "Élan", "elan b", "Zoë", None]
    df = spark.createDataFrame([(t,) for t in reversed(titles)], "title string")
    found = [r["title"] for r in df.orderBy(catalogue.natural_key(F.col("title"))).collect()]
    assert found == [None, "á 1", "A 2", "Ä 10", "a 0011", "a 999999999999999999999999", "A 1000000000000000000000000", "b", "Élan", "elan b", "ß 1", "ST 3", "Zoë"]


def test_diversity(spark):
    ranked = spark.createDataFrame([(1, m, m, 90 - 10 * m) for m in range(1, 6)], "msg long, macro_id long, rank long, confidence long")
    has = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "macro_id long, intent string")
    wants = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "msg long, intent string")
    topics = spark.createDataFrame([(1, True)], "msg long, multi_topic boolean")
    out = intents.diversified(ranked, has, wants, topics, ["msg"]).orderBy("slot").collect()
    assert [r["macro_id"] for r in out] == [1, 4, 5] or [r["macro_id"] for r in out] == [1, 4, 2]
    assert out[1]["macro_id"] == 4 and (out[2]["macro_id"] == 5) == (ranked.where("macro_id = 5").first()["confidence"] >= 35)


def test_top_k_leaves_out_vectors_without_direction(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vectors.top_k(df.where("vec_id IN (0, 2, 3)"), df, 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["other"]) for r in out] == [(0, 1), (0, 5)]
