"""Merkle manifest of a dataset: digests of rows, roots of groups, one root of all, and a proof for each row.

A leaf is the SHA-256 of a row's columns. The leaves of a group, in order, are folded by runs of FAN until one node, the group's root, is left; the groups'
roots, in order of the groups, are folded likewise. Digests are lowercase hex text, and a node hashes its children's texts one after the other.

Spark numbers the leaves of each group with a range sort, and deals them to aligned buckets of FAN ** LEVELS places: whatever lies in a bucket meets in
one node after LEVELS levels, so a bucket can be folded by itself. A task hands a block of buckets, as Arrow tables, to an in-memory DuckDB, which runs
one ordered string_agg with sha256 a level. The buckets' roots are the leaves of the next round, a table FAN ** LEVELS times smaller, until each group has
one root, and once more over the groups' roots. Proofs go the other way: each round meets the proofs of its buckets' roots in a cogrouped task, in which a
second pass of level queries puts every node's siblings before its parent's proof. No group of rows is larger than a bucket, but where many small groups
share a block; a hot group is spread over as many buckets as it needs.

Cases: a null column counts as `-`, so null and empty text differ; rows that share a key, or have none, are leaves of their own, null keys first, equal keys by
digest; equal rows have equal leaves and proofs of their own places; a null group is a group, the first one, and differs from the group ''; a group of one row
has that leaf as its root; a table of one group has its root as root; a proof may be empty, so its digest is that of no bytes; an empty table gives an empty
result; long texts are hashed whole; extra columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise, tasks_of

FAN = 3
#: Levels that one bucket folds: 2,187 leaves.
LEVELS = 7
PROOF = "array<struct<before string, after string>>"
NODE = "g string, pos long, total long, h string"


def row_digest(*values: Column) -> Column:
    """SHA-256 of values that are text or whole numbers: `-` for null, else their bytes' count, a colon and the value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


@lru_cache(maxsize=1)
def _engine() -> duckdb.DuckDBPyConnection:
    """The worker's own in-memory database: one thread, no files."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _fold(con: duckdb.DuckDBPyConnection, nodes: pa.Table, levels: int) -> None:
    """Tables l0 to l{levels}: the nodes of each level. total counts a group's nodes at that level; a group of one node is folded no more."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT g, pos, total, h FROM nodes")
    con.unregister("nodes")
    for k in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT g, pos // {FAN} AS pos, (total + {FAN - 1}) // {FAN} AS total, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{k} WHERE total > 1 GROUP BY g, pos // {FAN}, total")


def _block_roots(nodes: pa.Table, levels: int) -> pa.Table:
    """The root of each bucket, with its place among the buckets of its group."""
    con = _engine()
    _fold(con, nodes, levels)
    done = " UNION ALL ".join([f"SELECT * FROM l{k} WHERE total = 1" for k in range(levels)] + [f"SELECT * FROM l{levels}"])
    return con.sql(f"SELECT g, pos, total, h FROM ({done})").to_arrow_table()


def _block_proofs(nodes: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """subroot, root and proof of each node, in the order given, from those of the buckets' roots."""
    con = _engine()
    _fold(con, nodes, levels)
    con.register("above", above)
    con.execute("CREATE OR REPLACE TEMP TABLE up AS SELECT g, pos, subroot, root, proof FROM above")
    con.unregister("above")
    con.execute(f"CREATE OR REPLACE TEMP TABLE p{levels} AS SELECT n.g, n.pos, subroot, root, proof FROM l{levels} n JOIN up ON up.g = n.g AND up.pos = n.pos")
    for k in reversed(range(levels)):
        run = f"PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        siblings = f"SELECT g, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM l{k} WHERE total > 1"
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE p{k} AS SELECT n.g, n.pos, subroot, root, list_prepend({{'before': before, 'after': after}}, proof) AS proof FROM ({siblings}) n JOIN p{k + 1} p ON p.g = n.g AND p.pos = n.pos // {FAN} "
            f"UNION ALL SELECT n.g, n.pos, subroot, root, proof FROM l{k} n JOIN up ON up.g = n.g AND up.pos = n.pos WHERE n.total = 1"
        )
    con.register("asked", pa.table({"i": pa.array(range(nodes.num_rows), pa.int64()), "g": nodes.column("g"), "pos": nodes.column("pos")}))
    out = con.sql("SELECT subroot, root, proof FROM asked JOIN p0 USING (g, pos) ORDER BY i").to_arrow_table()
    con.unregister("asked")
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row among those of its group (column g, not null) by the order given, and total, how many those are. The table is written.

    A range sort over all rows deals them out evenly, equal keys too; what a partition holds of each group is counted, and the counts of the partitions
    before it are added.
    """
    # the place in the first table parts rows that are equal in all else, so a range may end among them
    kept = materialise(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves", "zstd")
    keys = ["g", *order, "_tie"]
    placed = kept.repartitionByRange(tasks_of(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "placed", "zstd")
    discard(kept)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a group has at most one row here for each partition
    until = F.expr("sum(_n) OVER (PARTITION BY g ORDER BY _part) - _n").alias("_before")
    runs = runs.select("g", "_part", "_first", until, F.expr("sum(_n) OVER (PARTITION BY g)").alias("total"))
    out = placed.join(runs, ["g", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
    out = materialise(out.drop("_at", "_part", "_first", "_before"), "numbered", "zstd")
    discard(placed)
    return out


def _blocks(nodes: DataFrame, n: int, levels: int, of_roots: bool = False) -> DataFrame:
    """Adds block: a bucket of a group that fills one is a block of its own, smaller groups are dealt to blocks of about a bucket's size."""
    size = FAN**levels
    bucket = F.col("pos") if of_roots else F.expr(f"pos div {size}")
    small = F.pmod(F.xxhash64("g"), F.lit(max(1, -(-n // size))))
    return nodes.withColumn("block", F.when(F.col("_large"), F.xxhash64("g", bucket)).otherwise(small))


def climbed(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], levels: int = LEVELS) -> DataFrame:
    """Adds subroot, root and proof to nodes (g, pos, total, h and any more columns); above gives those of the groups' last nodes."""
    size = FAN**levels
    nodes = nodes.withColumn("_large", F.col("total") >= size)
    n = nodes.count()
    dealt = _blocks(nodes, n, levels)
    roots = dealt.select("block", "g", "pos", "total", "h").groupBy("block").applyInArrow(lambda t: _block_roots(t, levels), NODE)
    roots = materialise(roots, "roots")
    upper = above(roots) if roots.where("total > 1").isEmpty() else climbed(roots, above, levels)
    # a group with a bucket that is full is large below as well
    large = nodes.groupBy("g").agg(F.max("_large").alias("_large"))
    upper = _blocks(upper.select("g", "pos", "subroot", "root", "proof").join(large, "g"), n, levels, of_roots=True)
    rest = [c for c in nodes.columns if c != "_large"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in rest) + f", subroot string, root string, proof {PROOF}"

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _block_proofs(left, right, levels)
        out = left.select(rest)
        for name in ("subroot", "root", "proof"):
            out = out.append_column(name, found.column(name))
        return out

    return dealt.groupBy("block").cogroup(upper.select("block", "g", "pos", "subroot", "root", "proof").groupBy("block")).applyInArrow(prove, schema)


def proved(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """The manifest of a table of leaves (g: its group, not null, h: its digest, and any more columns): adds pos, total, subroot, root and proof.

    A leaf's place in its group is by order; groups follow each other as their names do. proof lists, from the leaf up to the root, the digests of the siblings
    before and after, as one text each.
    """

    def of_groups(roots: DataFrame) -> DataFrame:
        tree = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("below"), "h"), ["below"])
        top = climbed(tree, lambda r: r.select("g", "pos", F.col("h").alias("subroot"), F.col("h").alias("root"), F.array().cast(PROOF).alias("proof")), levels)
        return top.select(F.col("below").alias("g"), F.lit(0).cast("long").alias("pos"), F.col("h").alias("subroot"), "root", "proof")

    return climbed(numbered(leaves, order), of_groups, levels)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def op13_merkle(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, one of two of which has lost its line breaks since."""
    text, tampered = F.col("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    digest = lambda t: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    changed = F.when(tampered & F.contains(text, F.lit("\n")), digest(F.replace(text, F.lit("\n"), F.lit(""))))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null before all others
    leaves = docs.select("doc_id", group.alias("g"), digest(text).alias("h"), changed.alias("_changed"))
    out = proved(leaves, ["doc_id", "h"], levels).withColumn("_root", folded(F.coalesce("_changed", "h"), F.col("proof")))
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), F.col("_root").alias("folded_root"), (F.col("_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """op13_merkle in DuckDB: both trees and the folding of proofs as recursive queries, level by level."""
    item = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda t: f"sha256({' || '.join(item(v) for v in ('doc_id', 'source', 'lang', 'n_chars', t))})"
    level = "SELECT g, lvl + 1, pos // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))"
    window = "OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN"
    sides = f"coalesce(string_agg(h, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
    return f"""WITH RECURSIVE steps AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claim FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM d),
tree(g, lvl, pos, total, h) AS (SELECT g, 0, pos, total, leaf FROM o UNION ALL {level} FROM tree WHERE total > 1 GROUP BY g, lvl, pos // 3, total),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
high(g, lvl, pos, total, h) AS (SELECT '', 0, pos, total, subroot FROM sub UNION ALL {level} FROM high WHERE total > 1 GROUP BY g, lvl, pos // 3, total),
depth AS (SELECT g, max(lvl) AS n FROM tree GROUP BY g),
siblings AS (SELECT 0 AS part, g, lvl, pos, {sides} FROM tree WHERE total > 1 UNION ALL SELECT 1, g, lvl, pos, {sides} FROM high WHERE total > 1),
leafs AS (SELECT row_number() OVER () AS i, o.doc_id, o.leaf, o.claim, o.g, o.pos, sub.pos AS up, sub.subroot, depth.n FROM o JOIN sub USING (g) JOIN depth USING (g)),
steps_up AS (SELECT i, lvl, b, a FROM leafs JOIN siblings s ON s.part = 0 AND s.g = leafs.g AND s.pos = leafs.pos // CAST(pow(3, s.lvl) AS BIGINT)
  UNION ALL SELECT i, leafs.n + s.lvl, b, a FROM leafs JOIN siblings s ON s.part = 1 AND s.pos = leafs.up // CAST(pow(3, s.lvl) AS BIGINT)),
proof AS (SELECT i, sha256(string_agg(b || a, '' ORDER BY lvl)) AS p, list({{'b': b, 'a': a}} ORDER BY lvl) AS s FROM steps_up GROUP BY i),
fold(i, k, h, s) AS (SELECT i, 0, claim, coalesce(s, []) FROM leafs LEFT JOIN proof USING (i) UNION ALL SELECT i, k + 1, sha256(s[k + 1].b || h || s[k + 1].a), s FROM fold WHERE k < len(s))
SELECT doc_id, leaf, subroot, top.h AS root, coalesce(p, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified FROM leafs LEFT JOIN proof USING (i) JOIN fold ON fold.i = leafs.i AND fold.k = len(fold.s), (SELECT h FROM high WHERE total = 1) top"""


ORACLE_SQL = _sql()
