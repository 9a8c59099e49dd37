"""Merkle manifest, source divergence and toxicity against plain Python, on tables with the odd cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tessella.llm")

from tessella.llm import divergence, merkle, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, g int, h int, block int"


def document(i, text, lang, source, n_chars=3):
    return (i, text, lang, source, n_chars, 1, 2, 3, 4)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def tree(leaves):
    """The root, and of each leaf the siblings before and after it on each level."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(places):
            first = at // 3 * 3
            run = level[first : first + 3]
            proofs[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            places[i] = at // 3
        level = [digest(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], proofs


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, above = tree([m[1] for m in made])
    out = []
    for (own, subroot, proofs), up in zip(made, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for before, after in proof + up:
                h = digest(before, h, after)
            out.append((r[0], leaf(r, r[1]), subroot, root, digest(*[b + a for b, a in proof + up]), h, h == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    sources = ["a"] * 20 + ["b", "é", "", None] + [str(k) for k in range(30)]
    out = [document(i if i % 17 else None, rng.choice([None, "", "a\nb", "xx", f"q\n{i}"]), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 1, i])) for i in range(300)]
    return out + [out[3]] * 3 + [document(5000, "long\n" * 200_000, "en", "a")]


@pytest.mark.parametrize("levels", [1, 7])
def test_merkle(spark, rows, levels):
    got = merkle.op13_merkle(spark.createDataFrame(rows, DOCS), levels).collect()
    assert sorted(map(tuple, got), key=str) == manifest(rows)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_merkle_small(spark, rows):
    for few in (rows[:1], rows[:4], [rows[1]] * 4):
        assert sorted(map(tuple, merkle.op13_merkle(spark.createDataFrame(few, DOCS)).collect()), key=str) == manifest(few)
    assert merkle.op13_merkle(spark.createDataFrame([], DOCS)).count() == 0


def test_merkle_proofs_are_whole(spark):
    """The operator itself hands out siblings, and any leaf folds to the root with them."""
    leaves = [("=x" if i % 3 else "=y", f"{i:04d}", digest(str(i))) for i in range(100)]
    out = merkle.proved(spark.createDataFrame(leaves, "g string, k string, h string"), ["k"], 2).collect()
    for r in out:
        h = r["h"]
        for s in r["proof"]:
            h = digest(s["before"], h, s["after"])
        assert h == r["root"] == out[0]["root"]
    assert {r["subroot"] for r in out if r["g"] == "=y"} == {tree([h for g, _, h in leaves if g == "=y"])[0]}


def audit(rows, min_docs, top):
    """Divergence with whole numbers of any size."""
    terms = [(r[2] or "", r[3] or "", Counter(divergence._TERM_BYTES and (r[1] or "").encode().translate(divergence._TERM_BYTES).decode().split())) for r in rows]
    out = []
    for lang in {t[0] for t in terms}:
        own = [t for t in terms if t[0] == lang]
        docs = Counter(w for _, _, c in own for w in c)
        kept = sorted(w for w in docs if docs[w] >= min_docs)
        count = defaultdict(Counter)
        for _, source, c in own:
            count[source].update({w: n for w, n in c.items() if docs[w] >= min_docs})
            count[source] += Counter()
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(count.values(), Counter())
        for s in count:
            pairs = [(sum(abs(p(count[s], w) - p(count[t], w)) for w in kept), t) for t in count if t != s]
            over = [(p(count[s], w) - p(whole, w), w) for w in kept if count[s][w] and p(count[s], w) > p(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out, key=str)


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 16)
    rng = random.Random(4)
    vocabulary = ["cat", "Dog", "ÄÖ–x", "é", "y1z", "\x00q"] + ["w" + "".join(rng.choice("abcd") for _ in range(3)) for _ in range(80)]
    rows = [document(i, rng.choice([None, "", " ".join(rng.choices(vocabulary, k=12))]), rng.choice(["en", "en", "en", None, "", f"rare{i}"]), rng.choice([None, "a", "b", "é", "Z", "a_", "a b"])) for i in range(900)]
    rows += [rows[0]] * 40 + [document(9000, "cat Dog " * 50_000, "en", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    got = divergence.op11_source_divergence(docs, min_docs=8, top=5, block=2, segment=2)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == audit(rows, 8, 5)


def test_divergence_of_nothing(spark):
    assert divergence.op11_source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    alike = [document(i, "one two", "en", s) for i, s in enumerate("ab")]
    assert sorted(map(tuple, divergence.op11_source_divergence(spark.createDataFrame(alike, DOCS)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_nnpu_stays_non_negative():
    """With a prior that is too high, plain unbiased risk would fall below 0; the texts that only look like the examples stay clean."""
    rng = np.random.default_rng(1)
    p, u = np.zeros((40, 6)), np.zeros((400, 6))
    p[:, 0] = 1
    u[:40, 0] = 1
    p[:, 2:], u[:, 2:] = rng.random((40, 4)) < 0.3, rng.random((400, 4)) < 0.3
    w = toxicity.nnpu(p, u, 0.2)
    score = 1 / (1 + np.exp(-(np.concatenate((u, np.ones((400, 1))), axis=1) @ w)))
    assert score[:40].min() > 0.3 > score[40:].max()
    assert abs(score.mean() - 0.2) < 0.01


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        w = [word() for _ in range(rng.randint(5, 80))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["Zounds!", "blackguard", "(cur", "ZOUNDS", "blackguards"])
        rows.append((i, " ".join(w), "s", i, 5, 0.5, "p"))
        if i % 2 == 0:
            labels.append((i, int(bad), "x"))
    rows += [(5000, None, "s", 0, 1, 0.5, "p"), (5001, "", "s", 0, 1, 0.5, "p"), (5002, "abc def " * 100_000 + "zounds", "s", 0, 1, 0.5, "p"), (None, "abc", "s", 0, 1, 0.5, "p"), (1, "zounds zounds", "s", 0, 1, 0.5, "p")]
    labels += [(None, 1, "x"), (77, None, "x"), (99999, 1, "x"), (0, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int, n int, h double, g string")
    return rows, docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity(judged):
    rows, docs, labels = judged
    out = toxicity.op12_toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] != 1}
    wrong = [i for i in range(1200) if i != 1 and by[i]["held_out"] and by[i]["predicted"] != (i % 8 == 0)]
    assert len(wrong) <= 3
    assert by[5002]["predicted"] == 1 and by[5000]["score"] == by[5001]["score"] < 0.3
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 1) == [0, 1]


def test_toxicity_without_examples(judged, spark):
    _, docs, labels = judged
    assert {r["score"] for r in toxicity.op12_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r["score"] for r in toxicity.op12_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.op12_toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_do_not_matter(judged):
    """Turning every held-out label over, and every clean text's label of the rest into none, changes no ranking of the held-out texts."""
    from pyspark.sql import functions as F

    _, docs, labels = judged
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda d: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in d.collect())
    assert score(toxicity.op12_toxicity(docs, labels)) == score(toxicity.op12_toxicity(docs, turned))
