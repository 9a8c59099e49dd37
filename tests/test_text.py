import pytest
from pyspark.sql import functions as F

from tessella.functions import classify, scoring, text
from tessella.operators import entities, library
from tessella.sources import importer


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("withdrawals", "withdrawal"), ("pending", "pend"), ("closes", "clos"), ("closed", "clos"), ("verified", "verify"), ("trc20", "trc20"), ("planned", "plan"), ("bus", "bus"), ("need", "need")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_tokens_and_noise(spark):
    assert one(spark, text.tokens(F.lit("Can't log-in, player’s été 2FA"))) == ["cant", "log", "in", "players", "été", "2fa"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, F.filter(F.array(*[F.lit(x) for x in ("a", "the", "123", "abcdef0123456789", "bonus")]), lambda t: ~text.is_noise(t))) == ["bonus"]


def test_render(spark):
    body = F.lit("Hi {{User|there}}, pay {{amount}} by {{ due_date }}. {{x$|y}}")
    out = one(spark, text.render(body, {"user": F.lit("  "), "amount": F.lit("$5"), "due_date": F.lit(None).cast("string")}))
    assert out.startswith("Hi there, pay $5 by [ENTER DUE DATE].")
    assert one(spark, text.list_variables(F.lit("{{b}} {{A|x}} {{b}}"))) == ["b", "a"]


def test_edit_ratio_and_url(spark):
    assert one(spark, text.edit_ratio(F.lit("abcd"), F.lit("abce"))) == 0.25
    assert one(spark, text.edit_ratio(F.lit(""), F.lit("a"))) == 1.0
    assert one(spark, text.url_key(F.lit("HTTPS://www.Ex.com/a/?q=1#z"))) == "ex.com/a"


def test_iban_and_luhn(spark):
    assert one(spark, text.iban_ok(F.lit("DE89 3704 0044 0532 0130 00"))) is True
    assert one(spark, text.iban_ok(F.lit("DE88 3704 0044 0532 0130 00"))) is False
    assert entities.luhn("4111111111111111") and not entities.luhn("4111111111111112")


def test_scores(spark):
    assert one(spark, scoring.confidence(F.lit(0.45))) == 50
    assert abs(one(spark, scoring.combined(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) - 1) < 1e-12
    assert one(spark, scoring.calibrated(F.lit(0.9))) == 1.0


def test_classes(spark):
    assert one(spark, classify.sentiment(F.lit("You are thieves!!!"))) == "angry"
    assert one(spark, classify.sentiment(F.lit("THANK YOU SO MUCH!!!"))) == "positive"
    assert one(spark, classify.urgency(F.lit("I want to end my life"), F.lit(None).cast("double"), F.lit(None).cast("double"))) == "critical"
    assert one(spark, classify.intent_scores(F.lit("hello")))[0]["intent"] == "general"


def test_spans_are_sorted_and_disjoint():
    t = "My name is Ana Lee, mail a.b@c.com, card 4111 1111 1111 1111, paid $20 on 2024-01-02, see https://x.y/z."
    found = entities.spans(t)
    assert [k for k, *_ in found] == ["name", "email", "card", "amount", "date", "url"]
    assert all(t[s:e] == v for _, v, s, e in found) and all(a[3] <= b[2] for a, b in zip(found, found[1:]))
    assert entities.masked_text("a@b.co then a@b.co and c@d.co") == "[EMAIL_1] then [EMAIL_1] and [EMAIL_2]"
    assert entities.masked_text(None) is None


def test_library(spark):
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, version long, t string")
    assert {tuple(r) for r in library.latest(v, "id", "version").collect()} == {(1, 2, "b"), (2, 1, "c")}
    facts = spark.createDataFrame([(1, "verified"), (1, "contradicted"), (2, "verified"), (3, "unchecked")], "id long, status string")
    assert {r["id"]: r["verification"] for r in library.rollup(facts, "id").collect()} == {1: "conflict", 2: "verified", 3: "unverified"}
    now = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    changes = spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "n", 1)], "id long, t string, at int")
    assert {tuple(r) for r in library.upsert(now, changes, "id", "at").collect()} == {(1, "x"), (2, "w"), (3, "n")}


def test_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title;Text;Tags\n"One; two";Body é;"a, A, b"\n;no title;\n', "utf-8")
    good, bad = importer.validated(importer.read_csv(spark, str(tmp_path / "a.csv")))
    assert [(r["title"], r["body"], r["tags"]) for r in good.collect()] == [("One; two", "Body é", ["a", "b"])]
    assert [r["problem"] for r in bad.collect()] == ["missing title"]
    (tmp_path / "b.json").write_text('{"macros": [{"name": "N", "content": "C", "labels": ["x", "y"]}]}')
    assert importer.read_json(spark, str(tmp_path / "b.json")).first()["tags"] == "x,y"
    (tmp_path / "c.txt").write_text("### First\r\nTags: a, b\r\nHello\r\nthere\r\n---\r\nSecond\nBody")
    rows = importer.read_text(spark, str(tmp_path / "c.txt")).collect()
    assert [(r["title"], r["body"], r["tags"]) for r in rows] == [("First", "Hello\nthere", "a, b"), ("Second", "Body", None)]
    assert importer.detect_delimiter("a;b,c") == "," and importer.detect_delimiter("a\tb\tc,d") == "\t"
    raw = spark.createDataFrame([(b"caf\xc3\xa9",), (b"caf\xe9",), ("é".encode("utf-16"),)], "b binary")
    assert [r[0] for r in raw.select(importer.decode_bytes(F.col("b"))).collect()] == ["café", "café", "é"]
