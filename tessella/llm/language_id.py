"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run in Arrow batches: the code points of a chunk of texts become one array, an n-gram is a mix of
neighbouring code points, and its hash picks a row of the log-probability matrix. The matrix has 2**bits rows and one
column a language, whatever the corpus size, so it can be broadcast; more than LANGUAGES languages are dealt to several matrices, each of which scores all
texts, and the best of a text's results is taken.

Cases: null text or text without a letter gives `und` with score 1.0; ties go to the language that sorts first; repeated rows
are predicted alike, and count once in training; an empty table gives an empty result; with no labelled row at all every text is `und`, one with a
letter with score 0.0; a very long text is scored whole, in time linear in its length; rows may repeat a doc_id or have none. Extra columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_arrow, materialise, text_chunks, unpacked

ORDERS = (2, 3)
BITS = 16
ALPHA = 0.1
#: Bound on the documents that the matrix is fitted on: all eligible ones up to it, else a sample by hash of text and language, each kept once.
TRAIN_DOCS = 8_000
#: Languages of one matrix: 256 make 64 MB.
LANGUAGES = 256
UND = "und"
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities by n-gram bucket (rows) and language (columns), and the log-priors."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk, texts kept apart by a space each, and where each text begins.

    A text keeps its length, so the offsets hold: the few letters whose lower case is longer stay as they are.
    """
    text = data.tobytes().decode("utf-8", "replace")
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) != len(data):  # bytes to code points: count the bytes that begin one
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offsets = begins[offsets]
    return points, offsets


def _buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point; the last order - 1 places have none."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ points[k : k + n]) * _MULT[k]
        h ^= h >> np.uint64(15)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _counts(batch: pa.RecordBatch, orders: tuple[int, ...], bits: int) -> pa.Table:
    """N-gram counts of a batch by language: rows (language, bucket, n)."""
    langs = batch.column("lang").to_pylist()
    sums: dict[str, np.ndarray] = {}
    for first, end, data, offsets in text_chunks(batch.column("text")):
        points, at = _code_points(data, offsets)
        for order in orders:
            b = _buckets(points, order, bits)
            for lang in set(langs[first:end]):
                parts = [b[at[i] : max(at[i], at[i + 1] - order + 1)] for i in range(end - first) if langs[first + i] == lang]
                total = np.bincount(np.concatenate(parts), minlength=1 << bits)
                sums[lang] = sums[lang] + total if lang in sums else total
    rows = [(lang, np.flatnonzero(v)) for lang, v in sums.items()]
    return pa.table({
        "lang": pa.array([x for x, k in rows for _ in range(len(k))], pa.string()),
        "bucket": pa.array(np.concatenate([k for _, k in rows] or [np.zeros(0, np.int64)]).astype(np.int32)),
        "n": pa.array(np.concatenate([sums[x][k] for x, k in rows] or [np.zeros(0, np.int64)]).astype(np.int64)),
    })


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, orders: tuple[int, ...] = ORDERS, bits: int = BITS, alpha: float = ALPHA, languages: int = LANGUAGES) -> list[LanguageModel]:
    """Fits the model on (text, lang) rows with text and lang; on at most about train_docs distinct ones, whatever is repeated. A part for each so many languages.

    What reaches the driver at once is the count matrix of a part: at most 2**bits rows a language.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) < int(1_000_003 * train_docs / n))
    rows = rows.distinct()
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language of the bounded sample
    names, total = sorted(prior), sum(prior.values())
    parts = [tuple(names[k : k + languages]) for k in range(0, len(names), languages)] or [()]
    counts = map_arrow(rows.select("text", "lang"), lambda b: _counts(b, orders, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts if len(parts) == 1 else materialise(counts, "grams")
    out = []
    for own in parts:
        found = (counts if len(parts) == 1 else counts.where(F.col("lang").isin(list(own)))).toPandas()
        matrix = np.full((1 << bits, max(1, len(own))), alpha)
        for k, lang in enumerate(own):
            grams = found[found["lang"] == lang]
            matrix[grams["bucket"].to_numpy(), k] += grams["n"].to_numpy()
        log_prob = np.log(matrix) - np.log(matrix.sum(axis=0))
        log_prior = np.array([np.log(prior[x] / total) for x in own] or [0.0])
        out.append(LanguageModel(own, log_prob.astype(np.float32), log_prior, orders, bits))
    return out


def _score(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior probability of each text, and the logarithm of the evidence that these are out of."""
    n = len(texts)
    pred, score, evidence = [UND] * n, np.ones(n), np.zeros(n)
    has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return pred, np.where(has_letter, 0.0, 1.0), evidence
    width = len(model.languages)
    for first, end, data, offsets in text_chunks(texts):
        points, at = _code_points(data, offsets)
        total = np.tile(model.log_prior, (end - first, 1))
        for order in model.orders:
            b = _buckets(points, order, model.bits)
            lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - order + 1)
            full = np.flatnonzero(hi > lo)
            if not len(full):
                continue
            cuts = np.stack((lo[full], np.minimum(hi[full], len(b))), 1).ravel()
            for k in range(width):
                column = np.append(model.log_prob[:, k][b], np.float32(0)).astype(np.float64)
                total[full, k] += np.add.reduceat(column, cuts)[::2]
        best = total.argmax(axis=1)
        top = total[np.arange(len(best)), best]
        share = np.exp(total - top[:, None]).sum(axis=1)
        post, evidence[first:end] = 1 / share, top + np.log(share)
        for i in range(end - first):
            if has_letter[first + i]:
                pred[first + i], score[first + i] = model.languages[best[i]], post[i]
    return pred, score, evidence


def predict(docs: DataFrame, models: list[LanguageModel], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior probability; only the text column is read for it.

    The parts of a model score one after the other, each adding to what those before it have found.
    """
    columns = [c for c in docs.columns if c not in (pred, score)]
    out = docs.select(*[F.col(f"`{c}`") for c in columns])
    for k, model in enumerate(models):
        out = _predicted(out, docs.sparkSession.sparkContext.broadcast(model), text, pred, score, k > 0)
    return out.select(*[F.col(f"`{c}`") for c in columns], pred, score)


def _predicted(docs: DataFrame, model_b, text: str, pred: str, score: str, more: bool) -> DataFrame:
    own = [pred, score, "_evidence"]
    columns = [c for c in docs.columns if c not in own] if more else docs.columns
    schema = T.StructType([f for f in docs.schema if f.name in columns])
    schema = T.StructType(schema.fields).add(pred, "string").add(score, "double").add("_evidence", "double")
    keep, text_at = [docs.columns.index(c) for c in columns], docs.columns.index(text)
    before = [docs.columns.index(c) for c in own] if more else []

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, p, e = _score(batch.column(text_at), model_b.value)
        if before:
            old, old_p, old_e = (batch.column(i) for i in before)
            old_p, old_e = np.asarray(old_p), np.asarray(old_e)
            known = np.array([x != UND for x in lang])
            both = np.where(known, np.logaddexp(e, old_e), e)
            new_p, old_p = np.where(known, p * np.exp(e - both), p), np.where(known, old_p * np.exp(old_e - both), old_p)
            later = known & (new_p > old_p)  # on a tie the language that sorts first stays
            lang, p, e = [n if up else o for n, o, up in zip(lang, old.to_pylist(), later, strict=True)], np.where(later, new_p, old_p), both
        columns = [batch.column(i) for i in keep] + [pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(e, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, f, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the model never sees a held-out document."""
    model = train(docs.where(~held_out()), train_docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Pipeline stage: the documents whose text has a language; those that are rejected, as their text is null or has no letter, go.

    A row without a lang gets the predicted one, where anything could be learned; no document goes for want of labels. The model is
    fitted without the held-out documents.
    """
    model = train(docs.where(~held_out()), train_docs)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = predict(docs.select("text", rest.alias("_rest")), model).where((F.col("lang_pred") != UND) | (F.col("score") < 1))
    learned = F.when(F.col("lang_pred") != UND, F.col("lang_pred"))
    return unpacked(found, docs.columns, lang=F.coalesce(F.col("_rest.lang"), learned))
