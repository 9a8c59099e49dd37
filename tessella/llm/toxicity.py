"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and texts without any label are learned from. The risk of a classifier is estimated without clean examples: what the unlabelled texts
lose when they are called clean, less what the toxic ones among them account for, which the toxic examples and the share of toxic texts (the class
prior) tell. That difference can't be negative in truth, so a classifier that drives it below 0 has begun to learn the examples by heart, and is stepped back.

Features are presence of words and of beginnings of words, by 64-bit hashes. Of those that several toxic examples have, the ones that
stand out most against the unlabelled texts (log-likelihood ratio) are kept, a fixed number at most. Each of a few linear classifiers is trained in numpy on all examples and
a part of the unlabelled texts; its bias is then set so that its mean probability over these is the prior, and the weights are averaged. A text is scored whole, in Arrow batches, in time linear in its length.

Cases: a null text is the empty one; empty texts, and those without a known feature, get the score of the bias alone; without a toxic example every score is 0;
equal texts score alike and count once in training; ties in the choice of features go to the smaller hash; rows may repeat a doc_id or have none (a row without
one is no label's, and not held out); labels that are null, or of unknown documents, are ignored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import CHUNK_BYTES, map_arrow, materialise
from tessella.llm.hashing import mix, powers, spans

#: Lengths of the beginnings of words that are features, beside whole words.
PARTS = (3, 4, 5, 7)
#: Bounds on the distinct texts that are learned from: all up to them, else a sample by hash of the text.
TOXIC_TEXTS, UNLABELLED_TEXTS = 4_000, 16_000
#: Features kept at most, toxic examples that must have one, log-likelihood ratio from which it stands out.
FEATURES, MIN_EXAMPLES, MIN_RATIO = 1_024, 4, 24.0
CLASSIFIERS = 4
#: Score from which a text is called toxic.
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of the features, ascending, their weights and the bias; no bias says that nothing was learned."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float | None


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Whether each code point below 2**16 is a letter or digit."""
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


def word_parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the beginnings of so many letters of all words, and of whole words, with the text that each lies in: a pair of arrays for each length, and one for words.

    Words are runs of letters and digits of the lower-cased text.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    word = _word_points()[np.minimum(points, (1 << 16) - 1)] | (points >= 1 << 16)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]  # a space ends the last text
    text = np.searchsorted(ends, start, "right")
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers(len(points))[0])))
    for n in PARTS:
        long = stop - start >= n
        yield spans(sums, start[long], start[long] + n) ^ np.uint64(n), text[long]
    yield spans(sums, start, stop), text


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_BYTES, with the first one's number; a longer text is a run of its own."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts.to_pylist()):
        t = t or ""
        if run and size + len(t) > CHUNK_BYTES // 4:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def present(texts: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the features that each text has, once each."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True
    found = [np.zeros(0, np.int64)]
    for h, text in word_parts(texts):
        some = maybe[(h >> np.uint64(48)).astype(np.int64)]
        h, text = h[some], text[some]
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        same = hashes[k] == h
        found.append(text[same] * len(hashes) + k[same])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(hashes), pairs % len(hashes)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """How many texts of a batch have each part of a word."""
    own = [np.zeros(0, np.uint64)]
    for _, run in _pieces(batch.column("text")):
        for h, text in word_parts(run):
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            own.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))] if len(h) else h)
    h, n = np.unique(np.concatenate(own), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """Distinct texts, at most about so many."""
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * most / n))
    return rows.distinct()


def stand_out(toxic: DataFrame, unlabelled: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Hashes of the words and beginnings that set toxic texts off most, ascending."""
    found = map_arrow(toxic, _counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_EXAMPLES).toPandas()
    n_toxic, n_all = toxic.count(), unlabelled.count()
    if not len(found) or not n_all:
        return np.zeros(0, np.uint64)
    hashes = np.sort(found["h"].to_numpy().view(np.uint64))
    known = toxic.sparkSession.sparkContext.broadcast(hashes)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.zeros(len(known.value), np.int64)
        for _, run in _pieces(batch.column("text")):
            sums += np.bincount(present(run, known.value)[1], minlength=len(sums))
        k = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(known.value[k].view(np.int64)), pa.array(sums[k])], names=["h", "c"])

    among = map_arrow(unlabelled, counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).toPandas()
    both = found.merge(among, on="h", how="left").fillna(0)
    a, c = both["n"].to_numpy(float), both["c"].to_numpy(float)
    share = (a + c) / (n_toxic + n_all)
    part = lambda x, n, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (n * e)), 0) + np.where(n > x, (n - x) * np.log(np.maximum(1 - x / n, 1e-12) / np.maximum(1 - e, 1e-12)), 0)
    ratio = 2 * (part(a, n_toxic, share) + part(c, n_all, share))
    ratio[a / n_toxic <= c / n_all] = 0
    h = both["h"].to_numpy().view(np.uint64)
    best = np.lexsort((h, -ratio))[:features]
    return np.sort(h[best[ratio[best] >= MIN_RATIO]])


def nnpu(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, that make the non-negative risk small under the logistic loss: Adam over all rows at once, from zero."""
    p, u = (np.concatenate((x.astype(np.float32), np.ones((len(x), 1), np.float32)), axis=1) for x in (toxic, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        fp, fu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        yes_p, yes_u = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))  # slopes of the loss as clean
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        of_clean = u.T @ yes_u / len(u) - prior * (p.T @ yes_p) / len(p)
        g = prior * (p.T @ (yes_p - 1)) / len(p) + of_clean if clean >= 0 else -of_clean
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w + np.eye(len(w))[-1] * _shift(u @ w, prior)


def _shift(f: np.ndarray, prior: float) -> float:
    """What is added to the logits of unlabelled texts so that their mean probability is the prior: by halving."""
    low, high = -20.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(f + mid, -30, 30)))).mean() < prior else (low, mid)
    return (low + high) / 2


def fit(toxic: DataFrame, unlabelled: DataFrame, prior: float, toxic_texts: int = TOXIC_TEXTS, unlabelled_texts: int = UNLABELLED_TEXTS, features: int = FEATURES, classifiers: int = CLASSIFIERS) -> ToxicityModel:
    """The model from toxic texts, texts of any kind (column text each) and the share of toxic ones among the latter."""
    text = F.coalesce("text", F.lit("")).alias("text")
    examples = materialise(_bounded(toxic.select(text), toxic_texts), "toxic")
    others = materialise(_bounded(unlabelled.select(text), unlabelled_texts), "unlabelled")
    hashes = stand_out(examples, others, features)
    if examples.isEmpty() or others.isEmpty():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), None)
    known = toxic.sparkSession.sparkContext.broadcast(hashes)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, run in _pieces(batch.column("text")):
            own: list[list[int]] = [[] for _ in run]
            if len(known.value):
                for t, k in zip(*present(run, known.value), strict=True):
                    own[t].append(int(k))
            out += own
        return pa.RecordBatch.from_arrays([batch.column("g"), batch.column("toxic"), batch.column("h"), pa.array(out, pa.list_(pa.int32()))], names=["g", "toxic", "h", "x"])

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toxic", "h"], ignore_index=True)
        x = np.zeros((len(pdf), len(known.value)), np.uint8)
        for i, k in enumerate(pdf["x"]):
            x[i, k] = 1
        is_toxic = pdf["toxic"].to_numpy(bool)
        w = nnpu(x[is_toxic], x[~is_toxic], prior) if is_toxic.any() and not is_toxic.all() else np.zeros(0)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "w": [w.tolist()]})

    h = F.xxhash64("text").alias("h")
    each = F.explode(F.sequence(F.lit(0), F.lit(classifiers - 1))).alias("g")  # every classifier sees all examples, which are few, and its part of the others
    dealt = examples.select("text", h, F.lit(True).alias("toxic"), each).unionByName(others.select("text", h, F.lit(False).alias("toxic"), F.pmod(h, F.lit(classifiers)).cast("int").alias("g")))
    made = map_arrow(dealt, rows, "g int, toxic boolean, h long, x array<int>").groupBy("g").applyInPandas(learned, "g int, w array<double>").collect()
    weights = [np.array(r["w"]) for r in sorted(made, key=lambda r: r["g"]) if r["w"]]
    if not weights:
        return ToxicityModel(hashes, np.zeros(len(hashes)), None)
    w = np.mean(weights, axis=0)
    return ToxicityModel(hashes, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic; only the text is looked at."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != name]
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in columns]
    schema = docs.select(*[f"`{c}`" for c in columns]).schema.add(name, "double")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, sums = known.value, np.zeros(batch.num_rows)
        if model.bias is None:
            out = sums
        else:
            for first, run in _pieces(batch.column(at)):
                if len(model.hashes):
                    t, k = present(run, model.hashes)
                    sums[first : first + len(run)] = np.bincount(t, model.weights[k], len(run))
            out = 1 / (1 + np.exp(-np.clip(sums + model.bias, -30, 30)))
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(out)], names=schema.names)

    return map_arrow(docs, f, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op12_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, toxic_texts: int = TOXIC_TEXTS, unlabelled_texts: int = UNLABELLED_TEXTS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the model never sees a held-out label, nor a clean one but for the share of toxic ones."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).collect()[0][0] or 0.0
    own = docs.select("doc_id", "text")
    toxic = own.join(known.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit(toxic.select("text"), own.where(~held_out()).select("text"), min(max(prior, 1e-4), 0.9), toxic_texts, unlabelled_texts)
    out = score(own.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
