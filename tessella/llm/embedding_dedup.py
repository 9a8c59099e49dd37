"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors of a label are one class; one representative of each goes on.
2. Each (label, length) is a cell. A cell of more than 2 * SHARD vectors is split: cluster centres are fitted on a bounded sample of it, a
   vector goes to its nearest centre's cell (home), and copies of it to the next ones, so cells overlap. That is repeated until the cells
   are small: the shards. Centres stay a table beside the cells; none of it passes the driver.
3. In each shard a flat graph is built point by point: a greedy search from the medoid finds candidates, robust pruning keeps
   at most DEGREE of them in different directions, and reverse edges are added. The adjacency lists that a vector has in its
   shards are united.
4. Every vector is searched in its home shard, over the united lists: a greedy search from the medoid, then, as long as members
   within the threshold are found, their neighbours too (range expansion). Every link is verified in double precision.
   The links of all shards, each once, are counted, and all of them are the edges of the components.
5. Audit: every class that holds a vec_id divisible by 20 is compared with all vectors of the label, in blocks. The labels of which less than RECALL of
   these links was found are dealt, built and searched again with more copies; what still misses links after that is compared in blocks, the exact
   way for the rest. What the audit finds is linked in any case. audited_links is what brute force finds for such a vector, its copies included, audited_found what the first search found of it,
   audited_held what the result holds.

Cases: a null label, and a vector that is null, empty, zero or holds null, NaN or infinite components link with nothing; equal vectors link
with each other; vectors of different length of a label are never compared; ties between centres go to the first; vectors that no centres tell
apart stay one larger shard; rows that repeat a vec_id, or have none, are vectors of their own; very long vectors are compared like others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from heapq import heappop, heappush, heappushpop

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import components, discard, map_arrow, materialise, with_rows

THRESHOLD = 0.98
#: Vectors of a shard (twice as many at most, where centres tell them apart), and cells that a vector goes to in a split, at first and in repeats.
SHARD, COPIES = 200, (3, 6)
#: Cells that a cell is split into at once, vectors for each that their centres are fitted on, and rounds of splitting.
FAN, SAMPLE, ROUNDS = 16, 8, 16
DEGREE, BEAM, ALPHA = 16, 24, 1.2
AUDIT, RECALL = 20, 0.99
AUDITED = ("audited_links", "audited_found", "audited_held")
#: Vectors of a block that is compared with another.
BLOCK = 1024


def _centres(pdf: pd.DataFrame) -> pd.DataFrame:
    """Unit centres of a cell by spherical k-means on its sample."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    x, k = _unit(pdf), min(int(pdf["k"].iloc[0]), len(pdf))
    c = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(4):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(axis=1), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-12), c)
    return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "centres": [c.ravel().tolist()]})


def _nearest(batch: pa.RecordBatch, copies: int) -> pa.Table:
    """The children of its cell that each vector goes to: a home row to `copies` of them, a copy to one."""
    take, child, home = [], [], []
    flags = batch.column("home").to_pylist()
    for i, (vec, centres) in enumerate(zip(batch.column("vec"), batch.column("centres"), strict=True)):
        v = vec.values.to_numpy()
        near = np.argsort(-(centres.values.to_numpy().reshape(-1, len(v)) @ (v / np.abs(v).max())), kind="stable")[: copies if flags[i] else 1].tolist()
        take += [i] * len(near)
        child += near
        home += [flags[i] and j == 0 for j in range(len(near))]
    at = pa.array(take, pa.int64())
    kept = [batch.column(c).take(at) for c in ("label", "dim", "cell", "rep", "vec")]
    return pa.table([*kept, pa.array(child, pa.int32()), pa.array(home, pa.bool_())], names=["label", "dim", "cell", "rep", "vec", "child", "home"])


def dealt(vectors: DataFrame, shard: int = SHARD, copies: int = COPIES[0]) -> DataFrame:
    """A row for each vector (label, rep, vec) and shard of it: label, dim, cell, home, rep, vec."""
    cells = vectors.select("label", F.size("vec").alias("dim"), F.xxhash64("label", F.size("vec")).alias("cell"), F.lit(True).alias("home"), "rep", "vec")
    done = None
    for depth in range(ROUNDS):
        large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
        large = materialise(large.select("cell", "n", F.least(F.lit(FAN), F.ceil(F.col("n") / shard)).cast("int").alias("k")), "large")
        if large.isEmpty():
            break
        small = cells.join(large, "cell", "left_anti")
        done = small if done is None else done.union(small)
        rest = cells.join(large, "cell")
        part = rest.where(F.pmod(F.xxhash64("rep", F.lit(depth)), F.lit(1_000_003)) < 1_000_003 * F.lit(SAMPLE) * F.col("k") / F.col("n"))
        centres = materialise(part.groupBy("cell").applyInPandas(_centres, "cell long, centres array<double>"), "centres")
        split = map_arrow(rest.join(centres, "cell").select("label", "dim", "cell", "home", "rep", "vec", "centres"), lambda b: _nearest(b, copies), "label long, dim int, cell long, rep long, vec array<double>, child int, home boolean")
        split = split.select("label", "dim", F.xxhash64("cell", "child").alias("cell"), "home", "rep", "vec")
        lost = rest.join(centres, "cell", "left_anti").select(cells.columns)  # a cell whose sample came out empty stays for the next round
        cells = materialise(split.union(lost), "cells")
    return materialise(cells if done is None else done.union(cells), "shards")


def compared(asked: DataFrame, held: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links of vectors (label, dim, rep, vec) with those held of the same label and length, all compared, in blocks: label, dim, asked, a, b."""
    key = ["label", "dim"]
    count = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = count(asked, "qs").join(count(held, "ps"), key)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(blocks, key).select(*key, own("qs").alias("q"), each("ps").alias("p"), F.lit(True).alias("asks"), "rep", "vec")
    p = held.join(blocks, key).select(*key, each("qs").alias("q"), own("ps").alias("p"), F.lit(False).alias("asks"), "rep", "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, x, reps = pdf["asks"].to_numpy(), _unit(pdf), pdf["rep"].to_numpy()
        one, two = np.nonzero(x[asks] @ x[~asks].T >= threshold)
        one, two = reps[asks][one], reps[~asks][two]
        one, two = one[one != two], two[one != two]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "asked": one, "a": np.minimum(one, two), "b": np.maximum(one, two)})

    return q.union(p).groupBy(*key, "q", "p").applyInPandas(run, "label long, dim int, asked long, a long, b long")


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very large or small components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _greedy(q: np.ndarray, x: np.ndarray, graph: list[list[int]], start: int, beam: int, within: float = 2.0) -> dict[int, float]:
    """Visited places and their cosines: neighbours of the `beam` best places are visited, and of all places at least `within`."""
    first = float(x[start] @ q)
    seen, todo, best = {start: first}, [(-first, start)], [first]
    while todo:
        cos, at = heappop(todo)
        if -cos < within and len(best) == beam and -cos < best[0]:
            break
        fresh = [p for p in graph[at] if p not in seen]
        if fresh:
            for p, s in zip(fresh, (x[fresh] @ q).tolist(), strict=True):
                seen[p] = s
                heappush(todo, (-s, p))
                if len(best) < beam:
                    heappush(best, s)
                else:
                    heappushpop(best, s)
    return seen


def _pruned(p: int, candidates: dict[int, float], x: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust pruning: the nearest candidate stays, and those that are alpha times nearer to it than to the point go."""
    order = sorted((c for c in candidates if c != p), key=lambda c: (-candidates[c], c))
    kept: list[int] = []
    while order and len(kept) < degree:
        best = order.pop(0)
        kept.append(best)
        if order:
            near = x[order] @ x[best]
            order = [c for c, s in zip(order, near.tolist(), strict=True) if alpha * (1 - s) > 1 - candidates[c]]
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> list[list[int]]:
    """Adjacency lists of a flat graph over unit vectors; the medoid is the first to go in."""
    graph: list[list[int]] = [[] for _ in x]
    start = medoid(x)
    for p in [start, *[i for i in np.random.default_rng(len(x)).permutation(len(x)).tolist() if i != start]]:
        if p == start:
            continue
        graph[p] = _pruned(p, _greedy(x[p], x, graph, start, beam), x, degree, alpha)
        for c in graph[p]:
            graph[c].append(p)
            if len(graph[c]) > degree + 8:
                graph[c] = _pruned(c, dict(zip(graph[c], (x[graph[c]] @ x[c]).tolist(), strict=True)), x, degree, alpha)
    return graph


def medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(axis=0)).argmax())


def _adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    reps = pdf["rep"].to_numpy()
    graph = build_graph(_unit(pdf))
    return pd.DataFrame({"rep": reps, "near": [reps[g] for g in graph]})


def _searched(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All links (a, b), a < b, found from the vectors whose home the shard is."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    x, reps = _unit(pdf), pdf["rep"].to_numpy()
    place = {r: i for i, r in enumerate(reps.tolist())}
    graph = [[place[r] for r in near if r in place] for near in pdf["near"]]
    start = medoid(x)
    mine = np.flatnonzero(pdf["home"].to_numpy()).tolist()
    found = {p: {o for o, s in _greedy(x[p], x, graph, start, BEAM, threshold).items() if s >= threshold and o != p} for p in mine}
    here = [(p, o) for p in mine for o in found[p] if p < o or p not in found.get(o, ())]
    one, two = reps[[p for p, _ in here]], reps[[o for _, o in here]]
    return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})


def searched(vectors: DataFrame, threshold: float, shard: int, copies: int) -> DataFrame:
    """The links (a, b) that the graphs over shards give."""
    shards = dealt(vectors, shard, copies)
    key = ["label", "dim", "cell"]
    near = shards.groupBy(*key).applyInPandas(_adjacency, "rep long, near array<long>")
    near = materialise(near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    got = shards.join(near, "rep").groupBy(*key).applyInPandas(lambda pdf: _searched(pdf, threshold), "a long, b long")
    links = materialise(got.distinct(), "links")
    discard(shards)
    return links


def audited(classes: DataFrame, threshold: float) -> DataFrame:
    """All links of the classes that are asked for, by brute force over the label: label, dim, asked, a, b."""
    whole = classes.select("label", F.size("vec").alias("dim"), "rep", "vec", "ask")
    return compared(whole.where("ask"), whole, threshold)


def repaired(links: DataFrame, truth: DataFrame, classes: DataFrame, threshold: float, shard: int) -> DataFrame:
    """The links (a, b) with those that the labels gain of whose audited links less than RECALL is there, and with the audited ones."""
    whole = classes.withColumn("dim", F.size("vec"))
    for copies in (*COPIES[1:], None):
        held = truth.join(links.withColumn("held", F.lit(1)), ["a", "b"], "left")
        short = held.groupBy("label", "dim").agg((F.count("held") / F.count("*")).alias("recall")).where(F.col("recall") < RECALL)
        short = materialise(short.select("label", "dim"), "short")
        if short.isEmpty():
            break
        asked = whole.join(short, ["label", "dim"], "left_semi")
        more = searched(asked, threshold, shard, copies) if copies else compared(asked, asked, threshold).select("a", "b")
        links = materialise(links.union(more).distinct(), "links")
    return materialise(links.union(truth.select("a", "b")).distinct(), "links")


def usable(embedding: str = "embedding", label: str = "label"):
    """Whether a vector can link with anything."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & F.col(embedding).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def op7_embedding_near_dedup(embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = with_rows(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), "vec_id")
    rows = rows.withColumn("ok", usable()).withColumn("vec", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)))
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("_row").alias("rep"), F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("vec_id") % AUDIT == 0), F.lit(False)).alias("ask"))
    classes = materialise(classes, "vectors")
    first = searched(classes, threshold, shard, COPIES[0])
    truth = materialise(audited(classes, threshold), "audit")
    links = repaired(first, truth, classes, threshold, shard)
    comps = components(links).withColumnRenamed("node", "rep")
    ends = links.union(links.select("b", "a")).toDF("rep", "other")
    weight = ends.join(classes.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("weight"))
    held = truth.join(first.withColumn("first", F.lit(1)), ["a", "b"], "left").join(links.withColumn("last", F.lit(1)), ["a", "b"], "left")
    held = held.select(F.col("asked").alias("rep"), F.when(F.col("asked") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"), "first", "last").join(classes.select(F.col("rep").alias("other"), "n"), "other")
    count = lambda c, name: F.sum(F.when(F.col(c).isNotNull(), F.col("n"))).alias(name)
    audit = held.groupBy("rep").agg(count("n", "audited_links"), count("first", "audited_found"), count("last", "audited_held"))
    copies = F.when(F.col("ask"), F.col("n") - 1).otherwise(0)  # they are linked as a class
    per = classes.select("rep").join(weight, "rep", "left").join(audit, "rep", "left").fillna(0, list(AUDITED))
    label = classes.join(per, "rep", "left").join(comps, "rep", "left").select("label", "vec", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"), *[(F.col(c) + copies).alias(c) for c in AUDITED])
    sure = rows.where("ok").join(label, ["label", "vec"]).select("_row", "vec_id", "n_links", "component", *AUDITED)
    rest = rows.where("NOT ok").select("_row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("_row").alias("component"), *[F.lit(None).cast("long").alias(c) for c in AUDITED])
    out = sure.union(rest)
    if not rows.where("vec_id IS NULL OR vec_id <> _row").isEmpty():
        least = out.groupBy("component").agg(F.min("vec_id").alias("least"))
        out = out.join(least, "component").withColumn("component", F.col("least")).drop("least")
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"), *AUDITED)
