"""The training-data operators against brute force on small tables that hold the odd cases."""

import hashlib
import io
import random
import re
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tessella.llm")

from pyspark.sql import functions as F  # noqa: E402

from tessella.llm import embedding_dedup, fingerprint, language_id, line_dedup, minhash, packing, quality, sentencepiece_fst, suffix_dedup, warc  # noqa: E402
from tessella.llm.common import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, n int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = words(rng, 60)
    base = words(rng, 120).split(" ")
    texts = [None, "", "  \n ", "Ok", "Ok", passage + " " + words(rng, 40), words(rng, 30) + "\n" + passage, "x" * 700, words(rng, 3000)]
    for _ in range(6):
        w = base[:]
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[5], " ".join(base), passage + "\n" + passage + "\n" + passage.replace("a", "b", 1), "<|endoftext|> a  b   c", "\U0001f600 a b c d e f g"]
    return [(i, t, ("en", "fr")[i % 2], "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated ids."""
    return spark.createDataFrame([(None if i % 5 == 0 else i % 7, *r[1:]) for i, r in enumerate(rows)], SCHEMA)


def test_language(spark, nothing, odd):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcdefg" if i % 2 else "tuvwxyz"), "aa" if i % 2 else "tt") for i in range(200)] + [(900, None, "aa"), (901, "12 !", None)]
    out = {r["doc_id"]: r for r in language_id.op1_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows[:200] if out[r[0]]["held_out"]]
    assert held and all(out[i]["lang_pred"] == lang for i, _, lang in held)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und"
    assert language_id.op1_language_id(nothing).count() == 0
    assert language_id.op1_language_id(odd).count() == odd.count()


def test_sentencepiece(docs, rows, nothing):
    sp = pytest.importorskip("sentencepiece")
    tok = pytest.importorskip("public_tokenizers")
    model = sp.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    m = sentencepiece_fst.public_machine()
    for t in [r[1] for r in rows if r[1]] + ["  a  b ", "▁x", "é\x00\n\t\U0001f600", "<s> <0x0A>"]:
        ids = model.encode(t)
        assert np.frombuffer(m.encode(t), "<u4").tolist() == ids
        assert m.decode(np.array(ids, "<u4").tobytes()) == model.decode(ids)
    assert all(r["round_trip"] for r in sentencepiece_fst.op2_sentencepiece(docs).collect())
    assert sentencepiece_fst.op2_sentencepiece(nothing).count() == 0


def test_packing(docs, rows, nothing, odd):
    tok = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    want = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    out = packing.op3_best_fit_packing(docs).collect()
    import zlib

    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] <= 1024 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 1024
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in out) == sum(map(len, want.values()))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == -(-sum(map(len, want.values())) // 1024) or len(by) <= 1 + -(-sum(map(len, want.values())) // 1024)
    assert packing.op3_best_fit_packing(nothing).count() == 0
    assert packing.op3_best_fit_packing(odd).count() == len(out)


def test_local_search_empties_bins():
    sizes = [6, 6, 4, 4, 5, 5]
    bins = packing.local_search([[0, 3], [1], [2, 4], [5]], sizes, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))


def test_groups_share_their_last_bins(spark):
    """Pieces in many small groups need one bin more than the bound at most, whatever their ids are."""
    rng = random.Random(7)
    rows = [(None, 0, 0, rng.randint(1, 300), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces, group_pieces=64).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    bound = -(-sum(r[3] for r in rows) // 1024)
    assert len(out) == 3000 and max(fill.values()) <= 1024 and len(fill) <= bound + 2


def removed(texts, width):
    seen = defaultdict(int)
    for t in texts:
        for j in range(len(t) - width + 1):
            seen[t[j : j + width]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - width + 1):
            if seen[t[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        out.append(gone)
    return out


def test_suffix_dedup(docs, rows, nothing, odd):
    texts = [(r[1] or "").encode() for r in rows]
    out = {r["doc_id"]: r for r in suffix_dedup.op4_suffix_array_dedup(docs).collect()}
    for r, t, gone in zip(rows, texts, removed(texts, 200), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (out[r[0]]["n_removed"], out[r[0]]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest())
        assert out[r[0]]["n_spans"] == len(re.findall(b"\1+", bytes(gone)))
    assert suffix_dedup.op4_suffix_array_dedup(nothing).count() == 0
    assert suffix_dedup.op4_suffix_array_dedup(odd).count() == odd.count()


def peeled(text):
    """The digests of a fingerprint, from its hex alone: any cell that is some digest's own is taken out of the digest's other cells."""
    power, at, found = int(text[:2], 16), 2, set()
    for _ in range(1 << power):
        attempt = int(text[at : at + 2], 16)
        n = fingerprint.ROWS_OF_CELLS * (fingerprint.CELLS << min(attempt, fingerprint.DOUBLINGS))
        cells = [int(text[at + 2 + 16 * k : at + 18 + 16 * k], 16) for k in range(n)]
        at += 2 + 16 * n
        again = True
        while again:
            again = False
            for c in [x for x in cells if x]:
                high = (c - (1 << 64) if c >> 63 else c) >> 24
                if xxh64(high) & 0xFFFFFF == c & 0xFFFFFF and c not in found:
                    h = xxh64(c - (1 << 64) if c >> 63 else c, xxh64_int(attempt))
                    m = n // 3
                    for r in range(3):
                        cells[((h >> (16 * r)) & 0xFFFF) % m + r * m] ^= c
                    found.add(c)
                    again = True
                    break
        assert not any(cells)
    assert at == len(text)
    return found


def xxh64(value, seed=42):
    import xxhash

    return xxhash.xxh64(value.to_bytes(8, "little", signed=True), seed=seed).intdigest()


def xxh64_int(value):
    import xxhash

    return xxhash.xxh64(value.to_bytes(4, "little", signed=True), seed=42).intdigest()


def test_fingerprints(spark, docs, rows, nothing, odd):
    long = {r["text"]: set(r["p"]) for r in docs.where("text IS NOT NULL").select("text", fingerprint.paragraphs(F.col("text")).alias("p")).collect()}
    cut = lambda t: long.get(t) or {p for r in spark.createDataFrame([(t,)], "text string").select(fingerprint.paragraphs(F.col("text")).alias("p")).collect() for p in r["p"]}
    plain = lambda t: {p for p in re.split(r"\n+|(?<=[.!?|])\s+", t) if p}
    split_long = split = lambda t: plain(t) if all(len(p) <= fingerprint.LONG for p in plain(t)) else cut(t)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {r["doc_id"]: r for r in fingerprint.op5_fingerprints(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        got = out[r[0]]
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got["near_edited"] - like(split(t), split(edited))) < 1e-9 and abs(got["near_next"] - like(split(t), split(nxt))) < 1e-9
        sets = []
        for name, text in (("fingerprint", t), ("edited_fingerprint", edited)):
            found = peeled(got[name])
            assert len(found) == len(split_long(text))
            sets.append(found)
        assert abs(got["near_edited"] - like(*sets)) < 1e-9  # a function of the two fingerprints
    assert out[3]["fingerprint"] == out[4]["fingerprint"]
    assert fingerprint.op5_fingerprints(odd).count() == odd.count()
    least = docs.limit(3).withColumn("doc_id", F.lit(-(2**63)) + F.col("doc_id"))
    assert fingerprint.op5_fingerprints(least).count() == 3
    assert fingerprint.op5_fingerprints(nothing).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_minhash(docs, rows, nothing, odd):
    sets = {r[0]: shingles(r[1]) for r in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    out = {r["doc_id"]: r for r in minhash.op6_minhash_near_dedup(docs).collect()}
    assert {i: (out[i]["n_shingles"], out[i]["component_id"]) for i in out} == {i: (len(sets[i]), least[i]) for i in sets}
    assert minhash.op6_minhash_near_dedup(nothing).count() == 0
    assert minhash.op6_minhash_near_dedup(odd).count() == odd.count()
    kept = minhash.keep_one_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if least[i] == i}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 7), (8, 6), (6, 8), (None, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {5: 1, 4: 1, 9: 1, 1: 1, 7: 7, 8: 6, 6: 6}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    x = np.concatenate((base, base[:60] + 0.05 * rng.normal(size=(60, 16)), base[:5]))
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 3 if i < 300 else (i - 300) % 60 % 3 if i < 360 else (i - 360) % 3) for i in range(len(x))]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, rows[0][1], None), (1004, [None] * 16, 1)]
    out = {r["vec_id"]: r for r in embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.array([r[1] for r in rows[:365]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:365]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    want = near.sum(axis=1) - 1
    got = np.array([out[i]["n_links"] for i in range(365)])
    assert np.minimum(got, want).sum() >= 0.9 * want.sum() and (got <= want).all()
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(1000, 1005))


def test_embedding_chains(spark):
    """Chains of near copies whose ids are not in order are one component each."""
    rng = random.Random(4)
    chains = [[1, 5, 2, 0], [3, 9, 4], rng.sample(range(10, 28), 18), rng.sample(range(30, 45), 15)]
    rows, want = [], {}
    for label, ids in enumerate(chains):
        for k, i in enumerate(ids):  # 10 degrees: cosine 0.985 to the next one, 0.940 to the one after
            rows.append((i, [float(np.cos(np.radians(10 * k))), float(np.sin(np.radians(10 * k)))], label))
            want[i] = (int(k > 0) + int(k < len(ids) - 1), min(ids), i == min(ids))
    rows.append((50, rows[1][1], 0))  # an exact copy of 5
    want |= {1: (2, 0, False), 2: (3, 0, False), 5: (3, 0, False), 50: (3, 0, False)}
    out = embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == want


def test_embedding_shards(spark):
    """Links across many small shards, and the audit's own count of them, against brute force."""
    rng = np.random.default_rng(8)
    x = np.concatenate((np.eye(16)[[0] * 200] + 0.034 * rng.normal(size=(200, 16)), rng.normal(size=(100, 16))))
    rows = [(int(i), [float(v) for v in x[k]], k % 2) for k, i in enumerate(rng.permutation(300))]
    found = embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=6).collect()
    out = {r["vec_id"]: r for r in found}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    want, least = near.sum(axis=1) - 1, ids.copy()
    for _ in rows:
        least = np.where(near, least[None, :], 10**6).min(axis=1)
    asked = ids % embedding_dedup.AUDIT == 0
    assert [out[i]["audited_links"] for i in ids.tolist()] == np.where(asked, want, 0).tolist()
    assert sum(r["audited_held"] for r in found) >= 0.9 * want[asked].sum()
    got = np.array([out[i]["n_links"] for i in ids.tolist()])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert [out[i]["component_id"] for i in ids.tolist()] == least.tolist()


def test_quality(spark, nothing):
    rng = random.Random(2)
    good = [(i, ". ".join(words(rng, 12) for _ in range(6)) + ".") for i in range(60)]
    bad = [(100 + i, "!! ".join(["BUY", "NOW", "$$$"] * 15)) for i in range(20)] + [(200, None), (201, "")]
    out = {r["doc_id"]: r["quality_score"] for r in quality.op8_quality(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert min(out[i] for i, _ in good) > max(out[i] for i, _ in bad)
    assert quality.op8_quality(nothing).count() == 0


def test_warc_archive(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000)]
    out = {r["page_id"]: r for r in warc.op9_warc(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (out[1]["record_type"], out[1]["refers_to"], out[2]["record_type"], out[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert (out[3]["record_type"], out[3]["refers_to"], out[3]["payload_bytes"]) == ("revisit", 4, 0)
    assert out[5]["payload_bytes"] == 100_000 and out[5]["payload_digest"] == warc.payload_digest(("é" * 50_000).encode())
    assert warc.op9_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_errors():
    records = [warc.record("response", "urn:x:1", "u", b"payload", warc.payload_digest(b"payload")) for _ in range(3)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    data = out.getvalue()
    assert [r for _, r in warc.read_frames(io.BytesIO(data))] == records
    for broken in (data[:-3], data[8:], data[:6]):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(broken)))
    for broken in (records[0][:-2], records[0].replace(b"WARC-Date", b"X-Date"), records[0].replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(broken)
    headers, block = warc.parse_record(records[0].replace(b"payload\r\n", b"PAYLOAD\r\n"))
    with pytest.raises(warc.WarcError):
        warc.payload_of(headers, block)


def edits_allowed(a, b):
    return min(line_dedup.EDITS, min(len(a), len(b)) // line_dedup.CHARS_PER_EDIT)


def within(a, b, k=2):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1] <= k


def test_line_dedup(spark, docs, rows, nothing, odd):
    rng = random.Random(5)
    line = "the quick brown fox jumps over the lazy dog"
    edits = [line, line[1:], line[:-2], "x" + line, line.replace("q", "Q"), line.replace("fox", "cat"), line[:20] + "é" + line[20:], line.replace("o", "0")]
    shorter = ["call us: 12 34", "call us: 12 35", "call us 12 34", "call us 12 3", "call me 12 99", "Yes, please", "Yes, pleas", "  ", "\t", "é"]
    more = [(1000 + i, "\n".join(rng.sample(edits, 4) + ["short", "short"] + rng.sample(shorter, 4)), "en", "s", 0, 1, 2) for i in range(12)]
    table = spark.createDataFrame(rows + more, SCHEMA)
    seen, want = [], {}
    for r in rows + more:
        kept = []
        for x in (r[1] or "").split("\n"):
            if x.strip():
                near = any(abs(len(x) - len(y)) <= 2 and (x == y or within(x, y, edits_allowed(x, y))) for y in seen)
                seen.append(x)
                if near:
                    continue
            kept.append(x)
        want[r[0]] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op10_line_dedup(table).collect()} == want
    assert line_dedup.op10_line_dedup(nothing).count() == 0
    assert line_dedup.op10_line_dedup(odd).count() == odd.count()


def test_stages_keep_columns(spark, docs, nothing):
    import corpus_pipeline

    for frame in (docs, nothing):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, "").count()


def test_clean_documents_stay(spark):
    rng = random.Random(9)
    clean = spark.createDataFrame([(i, words(rng, 80) + "\n" + words(rng, 60), "en", "s", 0, 1, 2) for i in range(30)], SCHEMA)
    now = clean
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
    assert {(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()} == {(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()}
    assert F is not None


# the odd cases, one table for all: null and repeated ids, repeated rows, very long texts, columns with clashing names


CLASH = ("_row", "_rest", "_key", "kept", "spans", "_new", "_cut", "n_lines", "new_text", "lang_pred", "score", "id", "line", "component", "h")


@pytest.fixture(scope="module")
def clashing(spark, rows):
    rng = random.Random(11)
    long = " ".join(words(rng, 12) + ("\n" if rng.random() < 0.2 else ".") for _ in range(3000))  # some 200,000 bytes
    texts = [r[1] for r in rows] + [long, long, "é" * 20_000, words(rng, 30) + "\nOk"]
    made = [(None if i % 6 == 0 else i % 9, t, None if i % 2 else "en", "s", len(t or ""), *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


@pytest.mark.parametrize("stage", range(4))
def test_stages_hand_on_clashing_columns(spark, clashing, stage):
    import corpus_pipeline

    out = corpus_pipeline.STAGES[stage][1](spark, clashing, "")
    assert out.columns == clashing.columns and dict(out.dtypes) == dict(clashing.dtypes)
    got = {r["id"]: r for r in out.collect()}
    had = {r["id"]: r for r in clashing.collect()}
    assert got and all([got[i][c] for c in ("doc_id", "source", *CLASH)] == [had[i][c] for c in ("doc_id", "source", *CLASH)] for i in got)
    changed = [i for i in got if got[i]["text"] != had[i]["text"]]
    assert all(got[i]["n_chars"] == len(got[i]["text"]) for i in changed) and bool(changed) == (stage in (1, 3))


@pytest.mark.parametrize("op", [language_id.op1_language_id, sentencepiece_fst.op2_sentencepiece, fingerprint.op5_fingerprints, quality.op8_quality, line_dedup.op10_line_dedup, minhash.op6_minhash_near_dedup, suffix_dedup.op4_suffix_array_dedup])
def test_queries_take_odd_tables(clashing, op):
    assert op(clashing).count() == clashing.count()


def test_embeddings_odd(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.op7_embedding_near_dedup(nothing).count() == 0
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.001], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0, 0.0], 1), (5, [], 1), (6, [1e300, 1e-300], 1)]
    out = embedding_dedup.op7_embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(r["n_links"] for r in out) == [0, 0, 0, 3, 3, 3, 3] and {r["component_id"] for r in out if r["n_links"]} == {3}


def test_language_against_brute_force(spark):
    """Every score and language of a table against naive Bayes with a count for each n-gram's bucket, text by text."""
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnoé"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))), x) for i, x in enumerate(rng.choices(sorted(letters), k=120))]
    rows += [(200, "É x", None), (201, "a", "aa"), (202, "123", "bb"), (203, None, "cc")]
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    grams = lambda t: [int(b) for n in language_id.ORDERS for k in range(len(t) - n + 1) for b in language_id._buckets(np.array([ord(c) for c in t.lower()[k : k + n]], np.uint32), n, language_id.BITS)]
    seen = {(t, x) for i, t, x in rows if not held[i] and t is not None and x}
    count, docs_of = {x: defaultdict(int) for x in letters}, defaultdict(int)
    for t, x in seen:
        docs_of[x] += 1
        for g in grams(t):
            count[x][g] += 1
    out = {r["doc_id"]: r for r in language_id.op1_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        assert out[i]["held_out"] == held[i]
        if not any(c.isalpha() for c in t or ""):
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 1.0)
            continue
        log = {x: np.log(docs_of[x] / len(seen)) + sum(np.log((count[x][g] + language_id.ALPHA) / (sum(count[x].values()) + language_id.ALPHA * 2**language_id.BITS)) for g in grams(t)) for x in letters}
        best = max(sorted(log), key=log.get)
        assert out[i]["lang_pred"] == best and abs(out[i]["score"] - 1 / sum(np.exp(v - log[best]) for v in log.values())) < 1e-3


def test_language_stage_without_labels(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in language_id.keep_identified(bare).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    filled = language_id.keep_identified(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")))
    assert {r["lang"] for r in filled.collect()} == {"en"}


def test_label_model_against_rows():
    """Expectation-maximisation over patterns against the same over single rows, with plain loops."""
    rng = random.Random(13)
    truth = [rng.random() < 0.6 for _ in range(400)]
    says = lambda good, right: float(good if rng.random() < right else not good)
    rows = [[says(g, 0.9), says(g, 0.8) if rng.random() < 0.7 else float("nan"), says(g, 0.7), says(g, 0.85)] for g in truth]
    kinds = defaultdict(int)
    for r in rows:
        kinds[tuple("n" if v != v else v for v in r)] += 1
    patterns = np.array([[float("nan") if v == "n" else v for v in k] for k in kinds])
    model = quality.fit_labels(patterns, np.array(list(kinds.values()), float), tuple("abcd"), rounds=20)
    good, bad, prior = [0.8] * 4, [0.8] * 4, 0.7
    for _ in range(20):
        p = []
        for r in rows:
            yes, no = prior, 1 - prior
            for j, v in enumerate(r):
                if v == v:
                    yes *= good[j] if v else 1 - good[j]
                    no *= 1 - bad[j] if v else bad[j]
            p.append(yes / (yes + no))
        for j in range(4):
            own = [(q, r[j]) for q, r in zip(p, rows, strict=True) if r[j] == r[j]]
            good[j] = min(0.999, max(0.5, (sum(q * v for q, v in own) + 4) / (sum(q for q, _ in own) + 5)))
            bad[j] = min(0.999, max(0.5, (sum((1 - q) * (1 - v) for q, v in own) + 4) / (sum(1 - q for q, _ in own) + 5)))
        prior = min(0.98, max(0.02, sum(p) / len(p)))
    assert np.allclose(model.good, good, atol=1e-3) and np.allclose(model.bad, bad, atol=1e-3) and abs(model.prior - prior) < 1e-3
    assert sum((q > 0.5) == g for q, g in zip(p, truth, strict=True)) > 0.9 * len(truth)


def test_scorer_does_not_depend_on_partitions(spark):
    rng = random.Random(14)
    rows = [(words(rng, 20), rng.random()) for _ in range(120)]
    one, many = (quality.train_scorer(spark.createDataFrame(rows, "text string, p double").repartition(n)) for n in (1, 7))
    assert np.array_equal(one, many)
    dealt = defaultdict(list)
    for r in spark.createDataFrame(rows, "text string, p double").select("text", "p", F.xxhash64("text").alias("h")).collect():
        dealt[r["h"] % quality.TRAIN_GROUPS].append((r["h"], r["text"], r["p"]))
    want = sum(quality.learned([t for _, t, _ in sorted(g)], [p for _, _, p in sorted(g)], quality.BITS, 3, 0.5) * len(g) for g in dealt.values()) / len(rows)
    assert np.allclose(one, want)


def test_long_texts_are_sorted_in_parts(monkeypatch):
    """The runs of a text in overlapping parts cover the same windows under the same anchors."""
    import pyarrow as pa

    from tessella.llm import common

    rng = random.Random(15)
    text = "".join(rng.choice("abc") for _ in range(3000)) + "x" * 500
    batch = pa.RecordBatch.from_pydict({"_row": [7], "text": [text]})

    def windows_of(size):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        return {(s, r["a"], r["h"]) for b in suffix_dedup._runs(iter([batch]), 40, 9, True) for r in b.to_pylist() for s in range(r["lo"], r["hi"] + 1)}

    assert windows_of(128) == windows_of(1 << 20) and len(windows_of(128)) == len(text) - 39


def test_pipeline_against_brute_force(spark, rows, tmp_path, monkeypatch):
    """run() on a table of its own: what each stage keeps, stage by stage, in plain Python."""
    import corpus_pipeline

    rng = random.Random(16)
    base, passage = words(rng, 150).split(" "), words(rng, 70)
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (3, 90)]
    texts = [None, "12 34", *[" ".join(base)], *near, words(rng, 90) + " " + passage, words(rng, 80) + " " + passage + "\n" + words(rng, 30), words(rng, 60) + "\nthe same line of text in two\n", "the same line of text in two\n" + words(rng, 50)]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    now = {i: t for i, t, *_ in table if t and any(c.isalpha() for c in t)}
    seen: list[str] = []
    for i in sorted(now):
        kept = []
        for x in now[i].split("\n"):
            if x.strip():
                again = any(x == y or (abs(len(x) - len(y)) <= 2 and within(x, y, edits_allowed(x, y))) for y in seen)
                seen.append(x)
                if again:
                    continue
            kept.append(x)
        now[i] = "\n".join(kept)
    least = {i: i for i in now}
    for _ in now:
        for i in now:
            for j in now:
                if 100 * len(shingles(now[i]) & shingles(now[j])) >= 75 * len(shingles(now[i]) | shingles(now[j])):
                    least[i] = min(least[i], least[j])
    now = {i: t for i, t in now.items() if least[i] == i}
    ids = sorted(now)
    for i, gone in zip(ids, removed([now[i].encode() for i in ids], 200), strict=True):
        now[i] = bytes(b for b, g in zip(now[i].encode(), gone, strict=True) if not g).decode("utf-8", "ignore")
    now = {i: t for i, t in now.items() if t.strip()}
    from tokenizers import Tokenizer

    tok = pytest.importorskip("public_tokenizers")
    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in now.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want and 3 <= len(want) < len(texts) - 2


def test_minhash_large_group(spark):
    """A large group of near copies, many of them just over or under the threshold to each other, against all pairs."""
    rng = random.Random(21)
    base = words(rng, 150).split(" ")
    texts = []
    for _ in range(260):
        w = base[:]
        for k in rng.sample(range(len(w)), rng.choice((0, 1, 2, 3, 4, 5))):
            w[k] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    texts += [words(rng, 120) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    under = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
            under += 70 * len(sets[i] | sets[j]) <= 100 * both < 75 * len(sets[i] | sets[j])
    out = {r["doc_id"]: r["component_id"] for r in minhash.op6_minhash_near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert under > 1000 and out == {i: root(i) for i in range(len(texts))}
