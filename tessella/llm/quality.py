"""Quality classifier by weak supervision.

Heuristic labellers look at a text and vote good (1), bad (0) or abstain. Their votes are counted as patterns: at most
3 ** labellers rows, whatever the corpus. Expectation-maximisation over the patterns estimates each labeller's accuracy and
the share of good texts, with no labels at all; the posterior of a pattern is the weak label of its documents. A linear
scorer over hashed words, and the labellers' own features, is trained on the weak labels of all distinct texts by averaged stochastic gradient:
the texts are dealt by hash to groups, whose number follows that of the texts, each group is trained on in a fixed order, and the weights are averaged by rows. So
scores don't depend on how the rows lie on a cluster.

The floor is where the label model's share of good texts puts it: as many of the distinct texts score below it as the model believes bad, found exactly.

Votes and features of a text are made once and written as a table of sparse rows, which everything later reads in place of the texts.

Cases: a null text is empty; an empty text, and one without a word, scores 0; equal texts score alike, and count once in training; ties don't arise;
an empty table gives an empty result; if all texts look alike, scores are the prior; a very long text is scored whole; rows may repeat a doc_id or have
none; extra columns are ignored by the query and handed on by score, except one that is called quality_score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, map_arrow, materialise
from tessella.llm.hashing import mix, prefix, spans

BITS = 12
#: Groups that the distinct texts are dealt to, at least; there are more where a group would have more than about GROUP_DOCS texts.
TRAIN_GROUPS = 8
GROUP_DOCS = 2_500
#: Groups whose weights are averaged in one task, or on the driver.
AT_ONCE = 64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def measures(text: Column) -> dict[str, Column]:
    """What the labellers look at."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    return {
        "n_words": F.size(words).cast("double"),
        "letters": F.char_length(F.regexp_replace(t, r"[^\p{L}]", "")) / n,
        "capitals": F.char_length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / n,
        "marks": F.char_length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'’-]", "")) / n,
        "distinct": F.size(F.array_distinct(words)) / n_words,
        "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "sentences": F.regexp_count(t, F.lit(r"[.!?](\s|$)")) / n_words,
    }


def votes(m: dict[str, Column]) -> dict[str, Column]:
    """Votes of the labellers: 1 good, 0 bad, null abstains."""
    w = lambda good, bad: F.when(bad, 0).when(good, 1)
    return {
        "length": w(m["n_words"] >= 40, m["n_words"] < 8),
        "letters": w(m["letters"] >= 0.75, m["letters"] < 0.6),
        "capitals": w(m["capitals"] < 0.1, m["capitals"] > 0.3),
        "marks": w(m["marks"] < 0.01, m["marks"] > 0.04),
        "distinct": w((m["distinct"] >= 0.3) & (m["n_words"] >= 8), (m["distinct"] < 0.15) & (m["n_words"] >= 20)),
        "lines": w(m["line_repeats"] == 0, m["line_repeats"] > 0.3),
        "sentences": w((m["sentences"] > 0.02) & (m["sentences"] < 0.3), (m["sentences"] == 0) | (m["sentences"] > 0.6)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Labellers' accuracies on good and on bad texts, and the share of good texts."""

    names: tuple[str, ...]
    good: np.ndarray
    bad: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns (NaN abstains)."""
        voted = ~np.isnan(patterns)
        v = np.nan_to_num(patterns)
        yes = np.where(voted, v * np.log(self.good) + (1 - v) * np.log(1 - self.good), 0).sum(axis=1) + np.log(self.prior)
        no = np.where(voted, v * np.log(1 - self.bad) + (1 - v) * np.log(self.bad), 0).sum(axis=1) + np.log(1 - self.prior)
        return 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, names: tuple[str, ...], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns; begins at accuracies of 0.8, so that good stays what most labellers call good."""
    k = patterns.shape[1]
    model = LabelModel(names, np.full(k, 0.8), np.full(k, 0.8), 0.7)
    if not len(patterns):
        return model
    voted = ~np.isnan(patterns)
    v = np.nan_to_num(patterns)
    for _ in range(rounds):
        p = model.posterior(patterns)
        yes, no = (counts * p)[:, None] * voted, (counts * (1 - p))[:, None] * voted
        good = ((yes * v).sum(axis=0) + 4) / (yes.sum(axis=0) + 5)
        bad = ((no * (1 - v)).sum(axis=0) + 4) / (no.sum(axis=0) + 5)
        prior = float(np.clip((counts * p).sum() / counts.sum(), 0.02, 0.98))
        new = LabelModel(names, np.clip(good, 0.5, 0.999), np.clip(bad, 0.5, 0.999), prior)
        if np.abs(new.good - model.good).max() + np.abs(new.bad - model.bad).max() < 1e-6:
            return new
        model = new
    return model


def features(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed word counts (sub-linear, unit length) and five shape features of each text, as a dense row of 2**bits + 5."""
    for x in texts:
        text = x.as_py() or ""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        row = np.zeros((1 << bits) + 5, np.float32)
        row[-1] = 1
        if len(data):
            word = ~_SPACES[data]
            edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(start):
                h = spans(prefix(data), start, stop)
                counts = np.bincount((mix(h) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                w = np.log1p(counts).astype(np.float32)
                row[: 1 << bits] = w / np.linalg.norm(w)
                upper = len(re.findall(r"[A-ZÀ-Þ]", text))
                row[-5:-1] = (np.log1p(len(start)) / 10, len(np.unique(h)) / len(start), min(1, 5 * upper / len(text)), min(1.0, 10 * len(re.findall(r"[^\w\s.,;:'’-]", text)) / len(text)))
        yield row


def levelled(f: np.ndarray, target: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Slope and shift of logits that meet the weak labels best, by Newton's method: gradient steps alone leave all scores near the share of good texts."""
    x, w = np.stack((f, np.ones_like(f)), axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def sparse(row: np.ndarray) -> bytes:
    """A row of features as the places and values of those that aren't zero; by value, and the places' first bytes before their second ones, so that it packs well."""
    at = np.flatnonzero(row)
    at = at[np.argsort(row[at], kind="stable")]
    kind = np.dtype(np.uint32 if len(row) > 1 << 16 else np.uint16)
    return at.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() + row[at].tobytes()


def parts(packed: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a sparse row."""
    kind = np.dtype(np.uint32 if (1 << bits) + 5 > 1 << 16 else np.uint16)
    n = len(packed) // (kind.itemsize + 4)
    at = np.ascontiguousarray(np.frombuffer(packed, np.uint8, n * kind.itemsize).reshape(kind.itemsize, n).T).view(kind)[:, 0]
    return at, np.frombuffer(packed, np.float32, n, n * kind.itemsize)


def dense(rows: list[bytes], bits: int) -> np.ndarray:
    x = np.zeros((len(rows), (1 << bits) + 5), np.float32)
    for i, row in enumerate(rows):
        at, value = parts(row, bits)
        x[i, at] = value
    return x


def scored(row: bytes, weights: np.ndarray, bits: int) -> float:
    """Score of a sparse row; 0 if it has the constant alone, that is, no word."""
    at, value = parts(row, bits)
    return float(1 / (1 + np.exp(-np.clip(value.astype(np.float64) @ weights[at], -30, 30)))) if len(at) > 1 else 0.0


def learned(texts: list[str], target: list[float], bits: int, epochs: int, rate: float) -> np.ndarray:
    """learned_rows() of texts."""
    return learned_rows([sparse(row) for row in features(pa.array(texts, pa.string()), bits)], target, bits, epochs, rate)


def learned_rows(rows: list[bytes], target: list[float], bits: int, epochs: int, rate: float) -> np.ndarray:
    """Weights by stochastic gradient over the texts in the order given, in chunks of 2,000, each so many times, then levelled by the targets."""
    w, chunks = np.zeros((1 << bits) + 5, np.float64), range(0, len(rows), 2000)
    for first in chunks:
        x, y = dense(rows[first : first + 2000], bits), np.array(target[first : first + 2000])
        for _ in range(epochs):
            for i in range(0, len(x), 16):
                part = x[i : i + 16]
                miss = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30))) - y[i : i + 16]
                w -= rate * (part.T @ miss / len(part) + 1e-4 * w)
    logits = np.array([value.astype(np.float64) @ w[at] for at, value in (parts(row, bits) for row in rows)])
    slope, shift = levelled(logits, np.array(target))
    w *= slope
    w[-1] += shift
    return w


def with_features(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Replaces text by key, its digest, h, its hash, and row, its sparse features; a null text is empty."""
    kept = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    named = docs.select(*kept, F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    schema = named.drop("text").schema.add("row", "binary")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.array([sparse(row) for row in features(batch.column("text"), bits)], pa.binary())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], rows], names=schema.names)

    return map_arrow(named, f, schema)


def train_scorer(weak: DataFrame, bits: int = BITS, epochs: int = 3, rate: float = 0.5, groups: int = TRAIN_GROUPS) -> np.ndarray:
    """Weights of the linear scorer from rows (text, p): averaged over the groups, of which each makes one row."""
    return train_rows(with_features(weak.select("text", "p"), bits), bits, epochs, rate, groups)


def train_rows(weak: DataFrame, bits: int = BITS, epochs: int = 3, rate: float = 0.5, groups: int = TRAIN_GROUPS) -> np.ndarray:
    """The same from rows (key, h, row, p). Many groups' weights are averaged in rounds, AT_ONCE in a task, in the groups' order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key"], ignore_index=True)
        w = learned_rows(pdf["row"].tolist(), pdf["p"].tolist(), bits, epochs, rate)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "n": [len(pdf)], "w": [w.tolist()]})

    def averaged(pdf: pd.DataFrame) -> np.ndarray:
        out, total = np.zeros((1 << bits) + 5), pdf["n"].sum()
        for n, w in pdf.sort_values("g")[["n", "w"]].itertuples(index=False):
            out += np.array(w) * n / total
        return out

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[:1] // AT_ONCE, "n": [pdf["n"].sum()], "w": [averaged(pdf).tolist()]})

    dealt = weak.select("key", "h", "row", "p", F.pmod("h", F.lit(groups)).alias("g"))
    schema = "g long, n long, w array<double>"
    made = dealt.groupBy("g").applyInPandas(run, schema)
    while groups > AT_ONCE:
        made = made.groupBy(F.floor(F.col("g") / AT_ONCE)).applyInPandas(united, schema)
        groups = -(-groups // AT_ONCE)
    return averaged(made.toPandas())


def voted(docs: DataFrame) -> DataFrame:
    """Adds pattern, the labellers' votes as digits to the base of 3 (0 abstains, 1 bad, 2 good), the first labeller's last."""
    ms = docs.select("*", F.struct(*[c.alias(n) for n, c in measures(F.col("text")).items()]).alias("m"))
    digits = [F.coalesce(c + 1, F.lit(0)) * 3**i for i, c in enumerate(votes({n: F.col(f"m.{n}") for n in measures(F.col("text"))}).values())]
    return ms.withColumn("pattern", sum(digits[1:], digits[0]).cast("int")).drop("m")


def patterns_of(numbers: np.ndarray, labellers: int) -> np.ndarray:
    """Votes of pattern numbers: 1 good, 0 bad, NaN abstains."""
    digits = numbers.astype(np.int64)[:, None] // 3 ** np.arange(labellers) % 3
    return np.where(digits == 0, np.nan, digits - 1.0)


def at_share(values: DataFrame, share: float) -> float:
    """The exact quantile (numpy's method lower) of values that aren't negative, given as the column bits of their doubles' bits, which are in the same order.

    Each of four rounds counts 16 more bits of those values that begin as the one in question does; 0 if there are none.
    """
    found, place = 0, None
    for shift in (48, 32, 16, 0):
        part = values if place is None else values.where(F.shiftright("bits", shift + 16) == found)
        counted = part.groupBy(F.shiftright("bits", shift).alias("b")).agg(F.count("*").alias("c")).toPandas().sort_values("b")
        if not len(counted):
            return 0.0
        ends = counted["c"].to_numpy().cumsum()
        place = int((ends[-1] - 1) * share) if place is None else place
        i = int(np.searchsorted(ends, place, "right"))
        place, found = place - int(ends[i - 1] if i else 0), int(counted["b"].iloc[i])
    return float(np.int64(found).view(np.float64))


def fit_rows(rows: DataFrame, bits: int = BITS) -> tuple[LabelModel, np.ndarray]:
    """The label model and the scorer's weights from rows (pattern, key, h, row) of all documents; a text counts once for the scorer, whatever its copies."""
    names = tuple(votes({n: F.lit(0.0) for n in measures(F.col("text"))}))
    counted = rows.groupBy("pattern").agg(F.count("*").alias("c")).toPandas().sort_values("pattern")
    patterns = patterns_of(counted["pattern"].to_numpy(), len(names))
    model = fit_labels(patterns, counted["c"].to_numpy(float), names)
    believed = list(zip(counted["pattern"].tolist(), model.posterior(patterns).tolist(), strict=True))
    p = F.broadcast(rows.sparkSession.createDataFrame(believed, "pattern int, p double"))  # 3 ** labellers rows at most
    texts = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("pattern", "h", "row")])
    n = rows.select("key").distinct().count()
    return model, train_rows(texts.join(p, "pattern"), bits, groups=max(TRAIN_GROUPS, -(-n // GROUP_DOCS)))


def score_rows(rows: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """Replaces h, row and pattern by quality_score and bits, those of that double."""
    known = rows.sparkSession.sparkContext.broadcast(weights)
    rows = rows.drop("h", "pattern")
    schema = rows.drop("row").schema.add("quality_score", "double").add("bits", "long")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([scored(row, known.value, bits) for row in batch.column("row").to_pylist()])
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-2]], pa.array(out), pa.array(out.view(np.int64))], names=schema.names)

    return map_arrow(rows, f, schema)


def fit_and_score(docs: DataFrame) -> tuple[LabelModel, np.ndarray, DataFrame]:
    """The label model, the weights, and a table of docs with key, quality_score and bits in place of text."""
    rows = materialise(with_features(voted(docs)), "features")
    model, weights = fit_rows(rows)
    table = materialise(score_rows(rows, weights), "scores")
    discard(rows)
    return model, weights, table


def floor_of(table: DataFrame, model: LabelModel) -> float:
    """The score below which as many distinct texts lie as the label model believes bad."""
    once = materialise(table.groupBy("key").agg(F.min("bits").alias("bits")).select("bits"), "once")
    floor = at_share(once, 1 - model.prior)
    discard(once)
    return floor


def fit(docs: DataFrame) -> tuple[LabelModel, np.ndarray, float]:
    """The label model, from the votes on all documents, the scorer, from all distinct texts, and the floor of their scores."""
    model, weights, table = fit_and_score(docs.select("text"))
    floor = floor_of(table, model)
    discard(table)
    return model, weights, floor


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """Adds quality_score, 0 to 1; a text without a word scores 0."""
    known = docs.sparkSession.sparkContext.broadcast(weights)
    columns = [c for c in docs.columns if c != "quality_score"]
    schema = docs.select(*columns).schema.add("quality_score", "double")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [scored(sparse(row), known.value, bits) for row in features(batch.column("text"), bits)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out)], names=schema.names)

    return map_arrow(docs, f, schema)


def op8_quality(docs: DataFrame, floor: float | None = None) -> DataFrame:
    """doc_id, quality_score and kept (score of at least floor, by default the fitted one) of every document."""
    model, _, table = fit_and_score(docs.select("doc_id", "text"))
    floor = floor_of(table, model) if floor is None else floor
    return table.select("doc_id", "quality_score", (F.col("quality_score") >= floor).alias("kept"))
