"""Top vectors by matrix products against every pair's cosine."""

import random

import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F
from riskloom.operators import retrieval
from riskloom.plans import catalog

NAN, INF = float("nan"), float("inf")


def brute(queries, vectors, k, least=None):
    met = vectors.crossJoin(queries).filter("query_id <> vec_id").withColumn("score", F.round(retrieval.cosine(F.col("query"), F.col("embedding")), 6))
    met = met if least is None else met.filter(F.col("score") >= least)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("least", [None, 0.2])
def test_top_k_is_exact(spark, monkeypatch, kind, least):
    """Copies, ties, nulls, odd numbers, zero and tiny vectors, other sizes; many blocks and chunks."""
    for name, value in (("BLOCK_VALUES", 8 * 60), ("QUERY_VALUES", 8 * 20), ("CHUNK", 7), ("LEAST_BLOCKS", 3)):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(5)
    rows = [[r.gauss(0, 1) for _ in range(8)] for _ in range(120)] + [[1.0] * 8] * 40 + [[1.0 + i * 1e-7] * 7 + [1.0] for i in range(10)]
    rows += [[0.0] * 8, [0.0] * 8, None, None, [None] + [1.0] * 7, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [1e-30] * 8, [1.0] * 3, [2.0, 1.0, 0.0], [], [None]] * 2
    ids = list(range(len(rows)))
    r.shuffle(ids)
    table = spark.createDataFrame([*zip(ids, rows), (None, rows[0]), (ids[3], rows[5])], f"vec_id long, embedding array<{kind}>")
    queries = table.filter("vec_id % 3 = 0").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found, want = (sorted(map(str, f(queries, table, 4, least).collect())) for f in (retrieval.top_k, brute))
    assert found == want


def test_top_k_broadcasts_nothing(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "vec_id long, embedding array<float>")
    df = retrieval.top_k(table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), table, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 100 and "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_vector_is_adjudicated(spark):
    """Not only vectors of some ids ask for their best."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = brute(table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), table, 1, 0.4).drop("rank")
    found = catalog.QUERIES["adjudicate_top1"](spark, SF).collect()
    assert sorted(map(str, found)) == sorted(map(str, want.collect())) and any(r.query_id % 100 for r in found)
