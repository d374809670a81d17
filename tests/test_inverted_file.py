"""The inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.operators import inverted_file as iv
from lexgrove.operators.vectors import cosine_topk


def clustered(spark, n=4000, width=16):
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.standard_normal((n // 20, width)), 20, axis=0) + 0.25 * rng.standard_normal((n, width))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], ["id", "vector"]).repartition(4)
    return vec.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), vec


def test_few_lists_where_vectors_lie_in_groups(spark):
    r = iv.report(*clustered(spark), 10, True).first()
    assert r["neighbours"] == 800 and r["recall"] >= 0.9 and r["coded_share"] < 0.2 and r["scored_share"] < 0.2


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, folder):
    points = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    vec = points.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    r = iv.report(vec.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), vec, 10, True).first()
    assert r["recall"] >= 0.9 and r["probes"] < r["lists"]


def test_scores_are_exact_and_long_lists_are_split(spark, monkeypatch):
    queries, vec = clustered(spark, 400)
    near, centroids, indexed = iv.topk(queries, vec, 5, True)
    whole = {tuple(r) for r in near.collect()}
    exact = {tuple(r)[::2] + (r["score"],) for r in cosine_topk(queries, vec, 5, True).collect()}
    assert len({(q, i, s) for q, _, i, s in whole} & exact) >= 0.9 * len(exact)
    monkeypatch.setattr(iv, "PART_ROWS", 3)
    assert {tuple(r) for r in iv.search(queries, vec, indexed, centroids, 5, True).collect()} == whole


def test_null_zero_repeated_and_no_vectors(spark):
    schema = "id string, vector array<double>"
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("a", [1.0, 0.0]), ("d", [0.6, 0.8])], schema)
    queries = vec.select(F.col("id").alias("query_id"), "vector").dropDuplicates()
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in iv.topk(queries, vec, 2)[0].collect()}
    assert got["a", 1] == ("a", 1.0) and ("c", 1) not in got
    none = vec.limit(0)
    assert iv.topk(queries, none, 2)[0].collect() == []
    assert iv.topk(queries.limit(0), vec, 2)[0].collect() == []
