"""The composed ranker and term reach against plain Python over a small library."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import lexical, ranker

BOOST = {"title": 3.0, "body": 1.0}
RELATED = [("pay", "refund"), ("refund", "pay"), ("bonus", "vip"), ("vip", "bonus")]


def stems(t):
    return [text.stem_word(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if not text.noise_word(w)]


def hashed(seed, s):
    h = seed
    for c in s:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    h ^= h >> 16
    h = h * 0x85EBCA6B % 2**32
    h ^= h >> 13
    h = h * 0xC2B2AE35 % 2**32
    h ^= h >> 16
    return (h >> 1) % 768, 1 if h % 2 else -1


def vector(t):
    v = [0] * 768
    words = [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if not text.noise_word(w)]
    for w in words:
        padded = f"\x02{w}\x03"
        for i in range(len(w)):
            b, s = hashed(0x85EBCA6B, padded[i : i + 3])
            v[b] += 250 * s
    for w, n in Counter(map(text.stem_word, words)).items():
        b, s = hashed(0x9E3779B9, w)
        v[b] += s * math.floor(1000 * (1 + math.log(n)) + 0.5)
    return v


def cosine(x, y):
    length = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    return sum(a * b for a, b in zip(x, y, strict=True)) / length if length else 0.0


def six(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def weight(q, t):
    """What a term that is asked for counts for a term of the library."""
    if q == t:
        return 1.0
    if len(q) >= 4 and t.startswith(q):
        return 0.375 * len(t) / (len(t) + 0.3 * (len(t) - len(q)))
    k = min(2, math.floor(0.2 * len(q) + 0.5)) if len(q) >= 5 else 0
    d = distance(q, t)
    return 0.45 * len(t) / (len(t) + d) if d <= k else 0.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def expected(messages, library, weights, wants, far=False):
    fields = {m["macro_id"]: {f: Counter(stems(m[f])) for f in BOOST} for m in library}
    n = sum(any(c for c in fs.values()) for fs in fields.values())
    mean = {f: (lambda ls: sum(ls) / len(ls))([sum(fs[f].values()) for fs in fields.values() if fs[f]]) for f in BOOST}
    df = Counter((f, t) for fs in fields.values() for f in BOOST for t in fs[f])
    most = max((m["use_count"] or 0) for m in library)
    out = {}
    for msg in messages:
        asked = list(dict.fromkeys(stems(msg["text"])))[:32]
        reached = Counter()
        for q in asked:
            for t in {t for _, t in df}:
                w = weight(q, t) if far else float(q == t)
                if w:
                    reached[t] += w
        rows, q = [], vector(msg["text"])
        for m in library:
            score = 0.0
            for f, boost in BOOST.items():
                length = sum(fields[m["macro_id"]][f].values())
                for t, tf in fields[m["macro_id"]][f].items():
                    idf = math.log(1 + (n - df[f, t] + 0.5) / (df[f, t] + 0.5))
                    score += reached[t] * boost * idf * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * length / mean[f])))
            raw = max(cosine(q, vector(m["title"])), 0.85 * cosine(q, vector(m["body"])))
            intent = max([weights.get(msg["id"], {}).get(i, 0) for i in m["intents"] or []] + [weights.get(msg["id"], {}).get(b, 0) / 2 for i in m["intents"] or [] for a, b in RELATED if a == i] + [0])
            used = math.log1p(m["use_count"] or 0) / math.log1p(most) * 0.6 + (0.4 if m["is_favorite"] else 0)
            rows.append({"m": m, "bm25": six(score), "sem": six(min(max((raw - 0.08) / 0.67, 0), 1)), "intent": intent, "use": used})
        best = max(r["bm25"] for r in rows)
        for r in rows:
            r["fit"] = six(0.42 * r["sem"] + 0.22 * r["intent"] + 0.06 * r["use"]) if r["intent"] else 0
        pool = {id(r) for c in ("bm25", "sem", "fit") for r in sorted((r for r in rows if r[c] > 0), key=lambda r: (-r[c], r["m"]["macro_id"]))[:40]}
        rows = [r for r in rows if id(r) in pool]
        for r in rows:
            r["lex"] = r["bm25"] / best * (1 - math.exp(-best / 60)) if best and r["bm25"] else 0.0
            other = bool(msg["products"] and r["m"]["products"] and not set(msg["products"]) & set(r["m"]["products"]))
            settled = bool(set(msg["resolved"] or []) & set(r["m"]["intents"] or []))
            r["score"] = six((0.42 * r["sem"] + 0.30 * r["lex"] + 0.22 * r["intent"] + 0.06 * r["use"]) * (0.5 if other else 1) * (0.7 if settled else 1))
            r["confidence"] = math.floor(100 / (1 + math.exp(-6.5 * (r["score"] - 0.45))) + 0.5)
        rows.sort(key=lambda r: (-r["score"], not r["m"]["is_favorite"], -(r["m"]["use_count"] or 0), r["m"]["title"] or "", r["m"]["macro_id"]))
        shown = rows[:1]
        has = set(shown[0]["m"]["intents"] or []) if shown else set()
        for i in wants.get(msg["id"], []):
            offers = [r for r in rows if r not in shown and i in (r["m"]["intents"] or [])]
            if len(shown) < 3 and i not in has and offers and offers[0]["confidence"] >= 35:
                shown.append(offers[0])
                has |= set(offers[0]["m"]["intents"])
        shown += [r for r in rows if r not in shown]
        out[msg["id"]] = [(r["m"]["macro_id"], rows.index(r) + 1, r["score"], r["confidence"]) for r in shown[:3]]
    return out


@pytest.fixture(scope="module")
def world():
    rng = random.Random(6)
    words = "payment payments payout refund refunded bonus bonuses bet bets deposit deposited withdrawal vip gold été account verify verification documents odds spins casino club".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kinds = ["pay", "refund", "bonus", "vip"]
    library = [
        {"macro_id": i, "title": rng.choice([None, "", say(2), say(3)]), "body": rng.choice([None, say(12), say(30)]), "intents": rng.choice([None, [], [rng.choice(kinds)], rng.sample(kinds, 2)]), "products": rng.choice([None, [], ["casino"], ["sports"]]), "is_favorite": rng.choice([None, True, False]), "use_count": rng.choice([None, 0, 3, 50])}
        for i in range(60)
    ]
    library += [dict(library[7], macro_id=100), dict(library[7], macro_id=101)]
    messages = [{"id": i, "text": rng.choice([None, "", "the", say(4), say(9) + " paymnet withdrawl", say(60)]), "products": rng.choice([None, ["casino"]]), "resolved": rng.choice([None, ["pay"]])} for i in range(30)]
    weights = {i: {k: rng.choice([0.2, 0.5, 0.9]) for k in rng.sample(kinds, rng.randint(0, 3))} for i in range(30)}
    wants = {i: sorted(w, key=lambda k: -w[k]) for i, w in weights.items() if len(w) >= 2 and i % 2}
    return library, messages, weights, wants


@pytest.mark.parametrize("far", [False, True])
def test_recommend(spark, world, monkeypatch, far):
    """Small blocks, so that lists are merged over tiles."""
    monkeypatch.setattr(ranker, "MESSAGES", 11)
    monkeypatch.setattr(ranker, "ROWS", 17)
    library, messages, weights, wants = world
    rows = spark.createDataFrame([tuple(m.values()) for m in library], "macro_id long, title string, body string, intents array<string>, products array<string>, is_favorite boolean, use_count long")
    asked = spark.createDataFrame([tuple(m.values()) for m in messages], "id long, text string, products array<string>, resolved array<string>")
    listed = spark.createDataFrame([(i, k, w) for i, ws in weights.items() for k, w in ws.items()], "id long, intent string, weight double")
    several = spark.createDataFrame(list(wants.items()), "id long, intents array<string>")
    reach = (lambda terms, known: lexical.reach(terms, known, ["id"])) if far else None
    out = ranker.recommend(asked, rows, ["id"], "macro_id", fields={f: F.col(f) for f in BOOST}, heads=["title"], weights=listed, related=spark.createDataFrame(RELATED, "a string, b string"), wants=several, reach=reach, title="title")
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["slot"]):
        got[r["id"]].append((r["macro_id"], r["rank"], r["combined"], r["confidence"]))
        assert len(r["reason"]) <= 160 and set(r["terms"]) <= set(stems(next(m["text"] for m in messages if m["id"] == r["id"])))
    want = {i: x for i, x in expected(messages, library, weights, wants, far).items() if x}
    assert dict(got) == want
    assert any(slot > 1 and rank > slot for x in want.values() for slot, (_, rank, *_) in enumerate(x, 1)) or any(x[1][1] != 2 for x in want.values() if len(x) > 1)


def test_recommend_from_nothing(spark, world):
    library, messages, *_ = world
    rows = spark.createDataFrame([tuple(m.values())[:3] for m in library], "macro_id long, title string, body string")
    asked = spark.createDataFrame([(m["id"], m["text"]) for m in messages], "id long, text string")
    none = spark.createDataFrame([], "id long, intent string, weight double")
    both = dict(fields={f: F.col(f) for f in BOOST}, heads=["title"], weights=none, related=spark.createDataFrame(RELATED, "a string, b string"), wants=spark.createDataFrame([], "id long, intents array<string>"))
    assert ranker.recommend(asked, rows.limit(0), ["id"], "macro_id", **both).count() == 0
    assert ranker.recommend(asked.limit(0), rows, ["id"], "macro_id", **both).count() == 0


def test_reach(spark):
    """Every pair of terms against a plain distance, accents and letters beyond the first plane included."""
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abé𝒳ñ") for _ in range(n))
    known = sorted({make(rng.randint(1, 11)) for _ in range(500)} | {"withdrawal", "withdrawals", "deposit"})
    asked = sorted({make(rng.randint(1, 11)) for _ in range(60)} | {"withdrawl", "depo", "dposti", "withdrawal"})
    terms = spark.createDataFrame([(i % 7, t, 0.5 if i % 2 else 1.0) for i, t in enumerate(asked)], "id long, term string, weight double")
    got = {(r["id"], r["term"]): round(r["weight"], 9) for r in lexical.reach(terms, spark.createDataFrame([(t,) for t in known], "term string"), ["id"]).collect()}
    want = defaultdict(float)
    for i, q in enumerate(asked):
        for t in known:
            if w := weight(q, t):
                want[i % 7, t] += w * (0.5 if i % 2 else 1.0)
    assert got == {k: round(v, 9) for k, v in want.items()}
    assert (asked.index("withdrawl") % 7, "withdrawal") in got


def test_words_as_in_the_jvm(spark):
    """What workers do to tokens equals the column expressions, on every token of the documents and on odd ones."""
    odd = ["", "a", "ties", "ied", "sied", "seed", "agreed", "planned", "falling", "missing", "buzzing", "sing", "lily", "boxes", "churches", "bus", "grass", "be", "été", "étés", "abcdef0123456789", "1234", "x" * 33, "yes", "eyeing", "eee", "freed", "tried", "ability", "ies", "ß", "ssed", "ooed"]
    df = spark.createDataFrame([(t,) for t in odd], "token string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    for r in df.unionByName(docs).distinct().select("token", text.stem(F.col("token")).alias("s"), text.is_noise(F.col("token")).alias("n")).collect():
        assert (text.stem_word(r["token"]), text.noise_word(r["token"])) == (r["s"], r["n"]), r


def test_blocks_are_packed_once(spark, monkeypatch):
    """Whatever the number of tiles, each side is written once, and no tile's rows are dealt out by a key; scores are those of one tile."""
    rows = [(i, f"red wine {'blue ' * (i % 5)} number{i % 7} {'term' + str(i)}") for i in range(40)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, f"red number{i % 7} term{i} blue") for i in range(20)], "q long, text string")
    whole = lambda df: sorted((r["q"], r["doc_id"], round(r["bm25"], 6), r["rank"]) for r in df.collect())
    one = whole(ranker.lexical_top(asked, docs, ["q"], "doc_id", 3))
    monkeypatch.setattr(ranker, "MESSAGES", 5)
    monkeypatch.setattr(ranker, "ROWS", 8)
    many = ranker.lexical_top(asked, docs, ["q"], "doc_id", 3)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "FlatMapCoGroups" not in plan
    assert whole(many) == one and len(one) == 60


def test_terms_are_counted_before_they_are_joined(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1, 2])], "id long, text_terms array<string>, text_counts array<long>")
    asked = spark.createDataFrame([(1, "a", 1.0)], "q long, term string, weight double")
    plan = ranker.weighted_terms(asked, rows, ["q"], "id", {"text": 1.0}).select("q", "weights")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") < plan.index("Aggregate [field")
