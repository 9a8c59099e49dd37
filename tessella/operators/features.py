"""Features of texts in one pass, without a shuffle: counted stems, and hashed vectors of whole numbers.

Tokens are cut in the JVM; a worker stems a token, and hashes its runs of three letters, when it first sees it.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import noise_word, stem_word, tokens

# Vectors must use them to be comparable. Weights are in thousandths, so that sums are exact.
DIM, WORD, TRIGRAM = 768, 1000, 250
SEED_WORD, SEED_TRIGRAM, PRIME = 0x9E3779B9, 0x85EBCA6B, 0x01000193
START, END = "\x02", "\x03"



def _bucket(seed: int, text: str) -> int:
    """Bucket and sign of a feature: 2 * bucket + (1 where it counts as positive). FNV-1a over UTF-16 units, then a 32-bit finaliser."""
    h = seed
    for unit in array("H", text.encode("utf-16-le", "surrogatepass")):
        h = (h ^ unit) * PRIME & 0xFFFFFFFF
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return (h >> 1) % DIM * 2 + (h & 1)


@lru_cache(maxsize=100_000)
def _gram(gram: str) -> int:
    return _bucket(SEED_TRIGRAM, gram)


class _Lexicon:
    """What a worker has learned of tokens: number of the stem (-1: noise), and the features of their runs of three letters, one after the other."""

    MOST = 500_000

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.stem_ids: dict[str, int] = {}
        self.stems: list[str] = []
        self.features, self.of_token, self.starts, self.grams = array("q"), array("q"), array("q", [0]), array("q")

    def learn(self, words: list[str]) -> None:
        for token in words:
            if token in self.ids:
                continue
            self.ids[token] = len(self.of_token)
            if noise_word(token):
                self.of_token.append(-1)
            else:
                stem = stem_word(token)
                if stem not in self.stem_ids:
                    self.stem_ids[stem] = len(self.stems)
                    self.stems.append(stem)
                    self.features.append(_bucket(SEED_WORD, stem))
                self.of_token.append(self.stem_ids[stem])
                padded = START + token + END
                self.grams.extend(_gram(padded[i : i + 3]) for i in range(len(token)))
            self.starts.append(len(self.grams))


@lru_cache(maxsize=1)
def _lexicon() -> _Lexicon:
    return _Lexicon()


def vectors_of(texts: list[list[str]], vectors: bool = True) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Stems of the tokens of each text, in order of first sight, their counts, and the text's vector, which is empty where none is asked for."""
    if len(_lexicon().ids) > _Lexicon.MOST:
        _lexicon.cache_clear()
    known = _lexicon()
    counted = [Counter(t) for t in texts]
    for c in counted:
        known.learn(c)
    features, of_token, starts, grams = (np.array(x, np.int64) for x in (known.features, known.of_token, known.starts, known.grams))
    for c in counted:
        ids, n = np.fromiter((known.ids[t] for t in c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
        ids, n = ids[of_token[ids] >= 0], n[of_token[ids] >= 0]
        own, first, place = np.unique(of_token[ids], return_index=True, return_inverse=True)
        counts, order = np.bincount(place, n, len(own)).astype(np.int64), np.argsort(first)
        if not vectors:
            yield [known.stems[i] for i in own[order]], counts[order], counts[:0]
            continue
        size = starts[ids + 1] - starts[ids]
        at = grams[np.repeat(starts[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        at = np.concatenate((at, features[own]))
        w = np.concatenate((np.repeat(TRIGRAM * n, size), np.floor(WORD * (1 + np.log(counts)) + 0.5).astype(np.int64)))
        yield [known.stems[i] for i in own[order]], counts[order], np.bincount(at >> 1, np.where(at & 1, w, -w), DIM).astype(np.int64)


def spread_out(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where the input has fewer; many files, as large tables have, are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def featured(df: DataFrame, keep: list[str], fields: dict[str, Column], vectors: bool = True) -> DataFrame:
    """keep, then for each field: terms and counts (`field_terms`, `field_counts`, in order of first sight) and, if asked for, vector (`field_vector`)."""
    names = list(fields)
    own = spread_out(df).select(*keep, *[tokens(c).alias(f"_tokens_{f}") for f, c in fields.items()])
    schema = df.select(*keep).schema
    for f in fields:
        schema = schema.add(f"{f}_terms", T.ArrayType(T.StringType())).add(f"{f}_counts", T.ArrayType(T.LongType()))
        schema = schema.add(f"{f}_vector", T.ArrayType(T.LongType())) if vectors else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = [batch.column(i) for i in range(len(keep))]
            for f in names:
                made = list(vectors_of(batch.column(f"_tokens_{f}").to_pylist(), vectors))
                ends = pa.array(np.cumsum([0, *(len(n) for _, n, _ in made)]), pa.int32())
                out.append(pa.ListArray.from_arrays(ends, pa.array([t for stems, _, _ in made for t in stems], pa.string())))
                out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([n for _, n, _ in made] or [np.zeros(0, np.int64)]))))
                if not vectors:
                    continue
                flat = np.concatenate([v for _, _, v in made] or [np.zeros(0, np.int64)])
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return own.mapInArrow(run, schema)


#: Rows of featured, and tokens of measured, whose features are held at once.
ROWS, CHUNK = 1024, 100_000


def whole_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: rows that share a key, or have none, as one text, with a line break between them. Only the keys are read for it, where each has one row."""
    df = df.select(key, text)
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    if twice.isEmpty():
        return df
    same = F.col(key).eqNullSafe(F.col("_key"))
    joined = df.join(twice, same, "left_semi").groupBy(key).agg(F.array_join(F.collect_list(text), "\n").alias(text))
    return df.join(twice, same, "left_anti").unionByName(joined)


def _pairs(rows: np.ndarray, ids: np.ndarray, n: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a row and an id, and how often each is there."""
    pairs, place = np.unique(rows * most + ids, return_inverse=True)
    return pairs // most, pairs % most, np.bincount(place, n, len(pairs)).astype(np.int64)


def measured(df: DataFrame, key: str, text: Column, vectors: bool = False) -> DataFrame:
    """key, dl (terms), n_terms (distinct ones) of each text that has any; with vectors n_buckets, largest, total and squares of its hashed vector too. No term or vector leaves the task."""
    names = ["dl", "n_terms", *(["n_buckets", "largest", "total", "squares"] if vectors else [])]
    schema = df.select(key).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, known = batch.column(1), _lexicon()
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            known.learn(words)
            of_token, features, starts, grams = (np.array(x, np.int64) for x in (known.of_token, known.features, known.starts, known.grams))
            tokens_ = np.array([known.ids[w] for w in words], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            if len(known.ids) > _Lexicon.MOST:
                _lexicon.cache_clear()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            out, first = [], 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1)
                size = last - first
                ids = tokens_[ends[first] : ends[last]]
                rows = np.repeat(np.arange(size), np.diff(ends[first : last + 1]))
                rows, ids, n = _pairs(rows[of_token[ids] >= 0], ids[of_token[ids] >= 0], None, max(1, len(of_token)))
                of_stem, stems, counts = _pairs(rows, of_token[ids], n, max(1, len(features)))
                made = [np.bincount(of_stem, counts, size).astype(np.int64), np.bincount(of_stem, minlength=size)]
                if vectors:
                    long = starts[ids + 1] - starts[ids]
                    at = grams[np.repeat(starts[ids] - np.cumsum(long) + long, long) + np.arange(long.sum())]
                    at, w = np.concatenate((at, features[stems])), np.concatenate((np.repeat(TRIGRAM * n, long), np.floor(WORD * (1 + np.log(counts)) + 0.5).astype(np.int64)))
                    place = np.concatenate((np.repeat(rows, long), of_stem)) * DIM + (at >> 1)
                    v = np.bincount(place, np.where(at & 1, w, -w), size * DIM).astype(np.int64).reshape(size, DIM)
                    made += [(v != 0).sum(axis=1), np.abs(v).max(axis=1), v.sum(axis=1), (v * v).sum(axis=1)]
                out.append(np.array(made, np.int64))
                first = last
            found = np.concatenate(out, axis=1) if out else np.zeros((len(names), 0), np.int64)
            some = np.flatnonzero(found[0] > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *(pa.array(x[some]) for x in found)], names=schema.names)

    return spread_out(df).select(key, tokens(text).alias("_tokens")).mapInArrow(run, schema)


def kept(df: DataFrame) -> DataFrame:
    """Computed once for all that reads it: a compressed table in the shared checkpoint folder where there is one."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/tessella-kept-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def terms_of(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, term, tf."""
    def of(f: str) -> Column:
        return F.transform(F.arrays_zip(f"{f}_terms", f"{f}_counts"), lambda x: F.struct(F.lit(f).alias("field"), x[f"{f}_terms"].alias("term"), x[f"{f}_counts"].alias("tf")))

    each = [of(f) for f in fields]
    return rows.select(key, F.inline(F.concat(*each)))
