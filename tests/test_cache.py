"""The embedding cache, and concepts of misspelt words."""

from pyspark.sql import functions as F

from tessella.operators import concepts, embedding_cache
from tessella.operators.features import DIM


def test_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "late payout"), (2, "late payout"), (3, None), (4, ""), (5, "bonus")], "id long, text string")
    first, n = embedding_cache.embedded(df, F.col("text"), folder, "hash:1", DIM)
    vectors = {r["id"]: r["vector"] for r in first.collect()}
    assert n == 3 and vectors[1] == vectors[2] and vectors[3] == vectors[4] and vectors[1] != vectors[5] and len(vectors[5]) == DIM
    again, n = embedding_cache.embedded(df, F.col("text"), folder, "hash:1", DIM)
    assert n == 0 and {r["id"]: r["vector"] for r in again.collect()} == vectors
    more, n = embedding_cache.embedded(df.unionByName(spark.createDataFrame([(6, "new")], df.schema)), F.col("text"), folder, "hash:1", DIM)
    assert n == 1 and more.count() == 6
    assert embedding_cache.embedded(df, F.col("text"), folder, "hash:2", DIM)[1] == 3
    short = lambda rows: rows.select("mark", F.array(F.lit(1.0)).alias("vector"))
    odd, n = embedding_cache.embedded(df, F.col("text"), folder, "hash:1", 1, short)
    assert n == 3 and {tuple(r["vector"]) for r in odd.collect()} == {(1.0,)}
    assert embedding_cache.entries(spark, folder, "hash:1", DIM).count() == 4
    assert embedding_cache.pruned(spark, folder, "hash:1", DIM, df, F.col("text")).count() == 3
    wrong, _ = embedding_cache.embedded(df, F.col("text"), folder, "hash:3", 7, short)
    assert {r["vector"] for r in wrong.collect()} == {None} and embedding_cache.entries(spark, folder, "hash:3", 7).count() == 0


def test_concept_ids(spark):
    v = spark.createDataFrame([("deposit", "deposit"), ("withdrawal", "withdrawal"), ("account", "account"), ("bonus", "free spins")], "concept string, phrase string")
    df = spark.createDataFrame([(1, "my withdrawl and the deposti"), (2, "the account, deposit deposit free spins"), (3, None), (4, "withdraw")], "id long, text string")
    got = {(r["id"], r["concept"]) for r in concepts.concept_ids(df, ["id"], F.col("text"), v, never=("account",)).collect()}
    assert got == {(1, "withdrawal"), (1, "deposit"), (2, "deposit"), (2, "bonus")}
