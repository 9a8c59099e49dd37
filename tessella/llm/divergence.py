"""How far the sources of a language differ: distances between all pairs of sources, and the terms that a source has too much of.

Terms are counted once by language, source and term, a batch of texts at a time before anything is shuffled. A language keeps the terms that enough of its
documents have. A source's smoothed frequencies over them are a vector of whole numbers, and a pair's distance is the sum of their differences.

The distances are dealt as two-dimensional tiles: the sources of a language are cut into blocks, and the tile (I, J) gets the vectors of its two blocks,
packed as binary chunks of the vocabulary. A tile goes over the chunks in order, with one chunk in memory, and adds to its submatrix of pairs. The vocabulary is dealt
to segments as well, so no tile reads more than a fixed number of chunks; the segments' submatrices are added up. A vector is copied once for each block of
sources, not once a pair, and terms that neither block has are never looked at: they differ by the same amount each, which is multiplied.

Cases: a null text, language or source is the empty string; a text without a term still makes its group occur; groups without kept terms have the smoothed
frequencies of none; a language that keeps no term has distances of 0 and no terms; a language with one source has no pairs; equal values are ranked by item as UTF-8;
repeated rows count as documents of their own; a very long text is one text, its terms counted whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise, tasks_of

#: Documents of a language that must have a term, what is added to each count, what frequencies are out of, terms that are listed of each source.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a block, terms of a chunk, chunks of a segment.
BLOCK, CHUNK, SEGMENT = 16, 4096, 32
#: Entries of a batch's counts from which they are handed on.
FLUSH = 200_000
#: Bytes of terms, lower-cased; all others become a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it). A term is a run of ASCII letters, lower-cased, and other letters and signs beyond ASCII."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            keys = [(lang, source, term, n, found.get(term, 0)) for (lang, source), (counts, found) in seen.items() for term, n in counts.items()]
            seen.clear()
            cols = list(zip(*keys, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = Counter(text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split(b" "))
                del terms[b""]
                counts, found = seen.setdefault((lang, source), (Counter(), Counter()))
                counts.update(terms)
                found.update(terms.keys())
                if sum(len(c) for c, _ in seen.values()) >= FLUSH:
                    yield rows()
        if seen:
            yield rows()

    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = each.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n_lang, chunk, place (in the chunk), for the terms that a language keeps. Chunks are dealt by hash and hold about CHUNK terms."""
    found = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    found = materialise(found, "terms")
    sizes = found.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total"))  # a row a language
    dealt = found.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.expr(f"1 + v div {CHUNK}")))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return dealt.withColumn("place", place)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) in whole numbers: three decimals of the quotient at a time, so nothing overflows."""
    d, r, q = total + SMOOTH * terms, count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + F.call_function("div", r, d), r % d
    return q + 1


def _shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array of counts."""
    d, r, q = np.int64(total + SMOOTH * terms), count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // d, r % d
    return q + 1


def groups_of(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, g (number within the language), total (occurrences of kept terms), v (kept terms of the language), lang_total."""
    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.select("lang", "v", F.col("total").alias("lang_total")).distinct()
    out = each.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    return out.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def _tiles(block: int) -> Column:
    """The tiles that a source's block is part of: (i, j) with i <= j, one for each block of its language."""
    own = F.expr(f"g div {block}")
    last = F.expr(f"(sources - 1) div {block}")
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j")))


class _Tile:
    """The submatrix of a tile while its chunks go by: first its sources are named, then come their vectors, chunk after chunk."""

    def __init__(self, key: list, block: int) -> None:
        self.key, self.block = key, block
        self.sources: dict[int, tuple[int, int, int]] = {}  # total, kept terms, share of a term that it hasn't
        self.vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.chunk, self.sums = None, None

    def name(self, g: int, total: int, v: int) -> None:
        self.sources[g] = (total, v, int(_shares(np.zeros(1), total, v)[0]) if v else 0)

    def take(self, chunk: int, g: int, places: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self._add()
            self.chunk = chunk
        self.vectors[g] = places, counts

    def _add(self) -> None:
        """The open chunk to the submatrix, without what terms that nobody has would add: of those pairs() takes the whole."""
        if self.sums is None:
            self.sums = np.zeros((len(self.sources), len(self.sources)), np.int64)
        if self.vectors:
            at = {g: k for k, g in enumerate(self.sources)}
            places = np.unique(np.concatenate([p for p, _ in self.vectors.values()]))
            none = np.array([s[2] for s in self.sources.values()])
            x = np.tile(none[:, None], (1, len(places)))
            for g, (p, n) in self.vectors.items():
                x[at[g], np.searchsorted(places, p)] = _shares(n, *self.sources[g][:2])
            for k in range(len(x)):
                self.sums[k] += np.abs(x - x[k]).sum(axis=1) - len(places) * np.abs(none - none[k])
            self.vectors.clear()

    def pairs(self) -> pa.RecordBatch:
        """lang, a, b, value of the pairs of this tile."""
        self._add()
        lang, i, j, segment = self.key
        out = []
        for k, (a, (_, v, x)) in enumerate(self.sources.items()):
            for m, (b, (_, _, y)) in enumerate(self.sources.items()):
                if a < b and (a // self.block, b // self.block) == (i, j):
                    out.append((lang, a, b, int(self.sums[k, m]) + (v * abs(x - y) if segment == 0 else 0)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["lang", "a", "b", "value"])


def distances(groups: DataFrame, counts: DataFrame, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """lang, a, b (numbers of two sources, a < b) and value, for every pair of a language.

    counts: lang, g, chunk, place, n of the kept terms.
    """
    groups = groups.withColumn("g", F.col("g").cast("long")).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    packed = counts.groupBy("lang", "g", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("x"))  # at most the terms of a chunk
    # a head in each segment names a tile's sources, those that have none of its terms too
    heads = groups.select("lang", "g", "sources", "total", "v", F.expr(f"explode(sequence(0L, (v div {CHUNK}) div {segment}))").alias("segment"), F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("array<struct<place:int,n:bigint>>").alias("x"))
    own = groups.select("lang", "g", "sources", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("v"))
    vectors = packed.join(own, ["lang", "g"]).select("lang", "g", "sources", "total", "v", F.expr(f"chunk div {segment}").alias("segment"), "chunk", F.col("x"))
    rows = heads.unionByName(vectors).withColumn("t", F.explode(_tiles(block))).select("lang", "t.i", "t.j", "segment", "chunk", "g", "total", "v", F.col("x.place").alias("place"), F.col("x.n").alias("n"))
    keys = ["lang", "i", "j", "segment"]
    dealt = rows.repartition(tasks_of(groups.sparkSession), *keys).sortWithinPartitions(*keys, "chunk", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            lists = [batch.column(c) for c in ("place", "n")]
            for r, (*key, chunk, g, total, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "chunk", "g", "total", "v")), strict=True)):
                if tile is None or key != tile.key:
                    if tile is not None:
                        yield tile.pairs()
                    tile = _Tile(key, block)
                if chunk < 0:
                    tile.name(g, total, v)
                else:
                    tile.take(chunk, g, *(np.asarray(x[r].values) for x in lists))
        if tile is not None:
            yield tile.pairs()

    return dealt.mapInArrow(run, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def op11_source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each source by distance, and its terms that its language has less of."""
    found = materialise(term_counts(docs), "counts")
    kept = materialise(kept_terms(found, min_docs), "kept")
    counts = materialise(found.select("lang", "source", "term", "n").join(kept.select("lang", "term", "n_lang", "chunk", "place"), ["lang", "term"]), "source-counts")
    discard(found)
    groups = materialise(groups_of(docs, kept, counts), "groups")
    numbered = counts.join(groups.select("lang", "source", F.col("g").cast("long").alias("g")), ["lang", "source"]).select("lang", "g", "chunk", "place", "n")
    half = distances(groups, numbered, block, segment)
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda g, c: groups.select("lang", F.col("g").cast("long").alias(g), F.col("source").alias(c))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = counts.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    excess = _share(F.col("n"), F.col("total"), F.col("v")) - _share(F.col("n_lang"), F.col("lang_total"), F.col("v"))
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}),
l AS (SELECT lang, count(k.term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(s.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(s.c, 0) + {SMOOTH})) // (g.n + {SMOOTH} * l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) WHERE part = 'pair' OR rank <= {TOP}"""
