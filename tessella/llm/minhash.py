"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Features. A document's set is its distinct five-word shingles. Documents with equal sets are one class, and only one
   representative of each class goes on.
2. Posting. A signature has COORDINATES minima; a representative is posted under each (coordinate, value). Two documents of
   similarity s collide in a coordinate with probability s, and are a candidate pair from MIN_COLLISIONS collisions on. A pair
   at exactly 0.75 has fewer in one of 7 * 10**8 cases, more similar pairs in still fewer.
3. Prefix. A pair with so many collisions also has one outside each side's MIN_COLLISIONS - 1 longest lists (by length, then number: one order
   for all), so these are left out, and so are lists of one member. A passage that very many documents share thus
   makes no pairs of documents that have enough else.
4. Skip merging. Lists are never merged as a whole. The first rounds hold each member against one pivot of each of its lists, take
   those it meets most often, and join the components of the links found; lists within one component are skipped from then
   on. In the last round each list skips its largest component: only the members outside it are held against the others. Pairs that can't
   reach the similarity are skipped by size, by how many of a document's shingles any other component has, and by parities: of 64 * PARITY_WORDS
   classes of shingles, two documents differ in the parity of as many at most as they differ in shingles.
5. Counting and verification. Collisions are counted from the two signatures; pairs over the match threshold are
   verified on full sets: 100 * intersection >= 75 * union. So no candidate link between components is lost, and a group of thousands of copies
   costs a few comparisons a member.

Cases: null text and text without words have an empty set, are linked with nothing and kept; equal texts are one class; of
tied pivots the one with the smaller hash, then number, is taken, which changes no component; very long texts are one set like others; an empty
table gives an empty result; rows that repeat a doc_id are documents of their own that carry it; a row without doc_id is kept; extra columns are
ignored by the operator and handed on by the pipeline stage, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import components, discard, map_arrow, materialise, packed, text_chunks, unpacked, with_rows
from tessella.llm.hashing import min_hashes, set_keys, shingle_sets

COORDINATES = 48
MIN_COLLISIONS = 17
PERCENT = 75
PARITY_WORDS = 16
#: Pivots that a member is held against, by round.
PIVOTS = (2, 4)


def _features(batch: pa.RecordBatch) -> pa.Table:
    """_row, n, k1, k2 and the coordinate values of a batch."""
    n, k1, k2, sig = [], [], [], []
    for _, _, data, offsets in text_chunks(batch.column("text")):
        values, at = shingle_sets(data, offsets)
        size = np.diff(at)
        a, b = set_keys(values, at)
        n.append(size), k1.append(a), k2.append(b)
        mins = min_hashes(values, at, COORDINATES)
        rows = iter(mins)
        sig += [next(rows).tobytes() if s else None for s in size]
    ints = lambda x: pa.array(np.concatenate(x), pa.int64())
    return pa.table({"_row": batch.column("_row"), "n": ints(n), "k1": ints(k1), "k2": ints(k2), "sig": pa.array(sig, pa.binary())})


def features(docs: DataFrame) -> DataFrame:
    return map_arrow(docs.select("_row", "text"), _features, "_row long, n long, k1 long, k2 long, sig binary")


def _postings(batch: pa.RecordBatch) -> pa.Table:
    """A row for each coordinate of each representative: list (coordinate and value), rep, n."""
    sig = _signatures(batch.column("sig"))
    key = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64)
    each = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), COORDINATES))
    return pa.table({"list": pa.array(key.ravel().view(np.int64)), "rep": each("rep"), "n": each("n")})


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _sets(batch: pa.RecordBatch) -> pa.Table:
    """The sets, and the parities of their classes of shingles, as words of 64 bits."""
    out: list[bytes] = []
    words: list[np.ndarray] = []
    classes = 64 * PARITY_WORDS
    for _, _, data, offsets in text_chunks(batch.column("text")):
        values, at = shingle_sets(data, offsets)
        for i in range(len(at) - 1):
            own = values[at[i] : at[i + 1]]
            out.append(own.tobytes())
            odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % classes, minlength=classes) & 1
            words.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    bits = np.stack(words)
    named = {f"p{k}": pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITY_WORDS)}
    return pa.table({"rep": batch.column("rep"), "sig": batch.column("sig"), "shingles": pa.array(out, pa.binary())} | named)


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs with enough collisions and, of these, with enough common shingles."""
    keep = (_signatures(batch.column("ga")) == _signatures(batch.column("gb"))).sum(axis=1) >= MIN_COLLISIONS
    sets = batch.column("sa"), batch.column("sb")
    for i in np.flatnonzero(keep).tolist():
        a, b = (np.frombuffer(x[i].as_py(), np.uint64) for x in sets)
        both = len(np.intersect1d(a, b, assume_unique=True))
        keep[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
    return batch.select(["ca", "cb"]).filter(pa.array(keep))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The components (ca, cb) of the pairs (a, b, ca, cb) of representatives that are linked."""
    a = sets.select(F.col("rep").alias("a"), F.col("sig").alias("ga"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("sig").alias("gb"), F.col("shingles").alias("sb"))
    return map_arrow(pairs.join(b, "b").join(a, "a").select("ca", "cb", "ga", "gb", "sa", "sb"), _verified, "ca long, cb long")


def _sizes_fit() -> str:
    return f"100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"


def prefixes(classes: DataFrame) -> DataFrame:
    """Posting lists (list, rep, n, weight) with more than one member, without each representative's MIN_COLLISIONS - 1 longest.

    The weight of a representative is the sum of the lengths of its lists: how much it collides with all others.
    """
    posted = map_arrow(classes.select("rep", "n", "sig"), _postings, "list long, rep long, n long")
    shared = materialise(posted.groupBy("list").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    longest = Window.partitionBy("rep").orderBy(F.desc("c"), F.desc("list"))  # COORDINATES rows at most
    weight = F.sum("c").over(Window.partitionBy("rep")).alias("weight")
    ranked = posted.join(shared, "list").select("list", "rep", "n", weight, F.row_number().over(longest).alias("place"))
    return ranked.where(F.col("place") >= MIN_COLLISIONS).drop("place")


def pivot_pairs(lists: DataFrame, most: int, salt: int) -> DataFrame:
    """Pairs (a, b, ca, cb): each member and, of the pivots of its lists that are in other components, the `most` it meets most often.

    The pivot of a list is its heaviest member in the first round, as a member in the middle of a group is linked with most of it, then any one.
    """
    pivot = F.min_by(F.struct("rep", "n", "component"), F.struct(F.lit(0) if salt else -F.col("weight"), F.xxhash64("rep", F.lit(salt)), "rep"))
    mixed = lists.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pivot.alias("y")).where("lo <> hi")
    both = lists.alias("x").join(mixed.select("list", "y"), "list").where(F.expr(f"x.component <> y.component AND {_sizes_fit()}"))
    pairs = both.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.count("*").alias("c"), F.min("x.component").alias("ca"), F.min("y.component").alias("cb"))
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")  # a row for each list of a member at most
    return pairs.withColumn("place", F.row_number().over(best)).where(f"place <= {most}").select("a", "b", "ca", "cb")


def _exploded(batch: pa.RecordBatch) -> pa.Table:
    parts = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
    size = [len(x) for x in parts]
    each = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), size))
    return pa.table({"s": pa.array(np.concatenate(parts)), "rep": each("rep"), "component": each("component")})


def left_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b, ca, cb) of different components that share a list and may be similar enough.

    At most the shingles of a document that some other component has can be common to a pair; m is their number.
    """
    sizes = lists.groupBy("list", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("list").agg(F.count("*").alias("k"), F.max_by("component", F.struct("c", "component")).alias("main")).where("k > 1")
    own = materialise(lists.join(mixed.select("list", "main"), "list"), "mixed")
    members = own.select("rep", "component").distinct()
    each = map_arrow(sets.join(members, "rep").select("shingles", "rep", "component"), _exploded, "s long, rep long, component long")
    each = materialise(each, "shingles")
    common = each.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s")
    m = materialise(each.join(common, "s", "left_semi").groupBy("rep").agg(F.count("*").alias("m")), "common")
    discard(each)
    words = [f"p{k}" for k in range(PARITY_WORDS)]
    own = own.join(m, "rep").where(f"100 * m >= {PERCENT} * n")  # the other one has m shingles at least
    own = materialise(own.join(sets.select("rep", *words), "rep"), "mixed")
    flips = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in words)
    fits = f"x.component <> y.component AND {_sizes_fit()} AND {100 + PERCENT} * least(x.m, y.m) >= {PERCENT} * (x.n + y.n) AND {100 + PERCENT} * ({flips}) <= {100 - PERCENT} * (x.n + y.n) AND (y.component = y.main OR x.rep < y.rep)"
    both = own.where("component <> main").alias("x").join(own.alias("y"), F.expr(f"x.list = y.list AND {fits}"))
    return both.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.min("x.component").alias("ca"), F.min("y.component").alias("cb"))


def links(docs: DataFrame, feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (rep, component) of the representatives that share lists with others, and the classes (k1, k2, n, rep).

    rep is the smallest document of a set.
    """
    classes = materialise(feats.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("_row").alias("rep"), F.min("sig").alias("sig")), "classes")
    lists = materialise(prefixes(classes).withColumn("component", F.col("rep")), "lists")
    wanted = classes.select(F.col("rep").alias("_row"), "sig").join(lists.select(F.col("rep").alias("_row")).distinct(), "_row", "left_semi")
    sets = materialise(map_arrow(docs.select("_row", "text").join(wanted, "_row").select(F.col("_row").alias("rep"), "sig", "text"), _sets, "rep long, sig binary, shingles binary, " + ", ".join(f"p{k} long" for k in range(PARITY_WORDS))), "sets")
    for r in range(len(PIVOTS) + 1):
        pairs = pivot_pairs(lists, PIVOTS[r], r) if r < len(PIVOTS) else left_pairs(lists, sets)
        new = materialise(verify(pairs, sets), "links")
        if new.isEmpty():
            continue
        to = components(new, "ca", "cb").toDF("component", "to")
        lists = materialise(lists.join(to, "component", "left").select("list", "rep", "n", "weight", F.coalesce("to", "component").alias("component")), "lists")
    discard(sets)
    return lists.select("rep", "component").distinct(), classes


def clusters(docs: DataFrame) -> DataFrame:
    """_row, n_shingles, component (the smallest _row linked to it, over any steps) of every row of a table with _row."""
    feats = materialise(features(docs), "features")
    comps, classes = links(docs, feats)
    label = classes.select("k1", "k2", "n", "rep").join(comps, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    joined = feats.select("_row", "n", "k1", "k2").join(label, ["k1", "k2", "n"], "left")
    return joined.select("_row", F.col("n").alias("n_shingles"), F.coalesce("component", "_row").alias("component"))


def op6_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows = with_rows(docs.select("doc_id", "text"))
    found = clusters(rows)
    if rows.columns[-1] == "_row" and rows.select("doc_id").where("doc_id IS NULL OR doc_id <> _row").isEmpty():
        out = found.select(F.col("_row").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        out = found.join(rows.select("_row", "doc_id"), "_row")
        smallest = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = out.join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document, that with the smallest doc_id, of each group of near-duplicates stays."""
    rows = packed(docs)
    kept = clusters(rows).where("_row = component").select("_row")
    return unpacked(rows.join(kept, "_row", "left_semi"), docs.columns)
