import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrove.operators import vectors as vx


def frames(spark, n=300, q=25, width=8, ids=int):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((n, width)).round(1)
    data[50:60] = data[40]  # ties
    data[70] = 0.0  # zero vector
    vec = spark.createDataFrame([(ids(i), v.tolist()) for i, v in enumerate(data)], ["id", "vector"])
    query = vec.select(F.col("id").alias("query_id"), "vector").limit(q)
    return data, query.repartition(2), vec.repartition(5)


def brute(data, q, k, skip_self, key=lambda i: i):
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = data / np.where(norm == 0, 1, norm)
    scores = np.round(unit @ unit.T, 9)
    out = set()
    for i in range(q):
        order = sorted(
            (j for j in range(len(data)) if not (skip_self and j == i)), key=lambda j: (-scores[i, j], key(j))
        )
        out |= {(key(i), r + 1, key(j), round(scores[i, j], 6)) for r, j in enumerate(order[:k])}
    return out


def collected(df):
    return {(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect()}


def test_both_ways_equal_brute_force(spark):
    data, queries, vec = frames(spark)
    for skip in (False, True):
        expected = brute(data, 25, 12, skip)
        assert collected(vx.cosine_topk(queries, vec, 12, skip)) == expected
        blocks = vx.cosine_topk(queries, vec, 12, skip, broadcast_values=0, block_values=90)
        assert collected(blocks) == expected


def test_string_ids_and_small_tables(spark):
    key = lambda i: f"k{i:03d}"
    data, queries, vec = frames(spark, n=80, q=10, ids=key)
    assert collected(vx.cosine_topk(queries, vec, 5, True)) == brute(data, 10, 5, True, key)
    few = vec.where("id < 'k003'")
    assert vx.cosine_topk(queries, few, 5).count() == 30
    assert vx.cosine_topk(queries.limit(0), vec, 5).count() == 0
    assert vx.cosine_topk(queries, vec.limit(0), 5).count() == 0


def test_running_best_over_many_batches(spark):
    data, queries, vec = frames(spark, n=300, q=10)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert collected(vx.cosine_topk(queries, vec.coalesce(1), 4, True)) == brute(data, 10, 4, True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_topk_is_monotone_in_k(spark):
    _, queries, vec = frames(spark)
    small = vx.cosine_topk(queries, vec, 3).select("query_id", "rank", "id")
    large = vx.cosine_topk(queries, vec, 6).where("rank <= 3").select("query_id", "rank", "id")
    assert small.exceptAll(large).count() == 0


def test_lsh_recall_and_split_buckets(spark, data):
    points = spark.read.parquet(f"{data}/embeddings.parquet")
    vec = points.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vec.select(F.col("id").alias("query_id"), "vector")
    exact = vx.cosine_topk(queries, vec, 5, True).select("query_id", "id")
    near = vx.lsh_topk(queries, vec, 5, 64, tables=16, bits=3, skip_self=True)
    recall = near.select("query_id", "id").intersect(exact).count() / exact.count()
    assert recall > 0.8
    split = vx.lsh_topk(queries, vec, 5, 64, tables=16, bits=3, skip_self=True, block_values=640)
    assert split.select("query_id", "id", "rank").exceptAll(near.select("query_id", "id", "rank")).count() == 0


def default_recall(queries, vec, k, width):
    exact = vx.cosine_topk(queries, vec, k, True).select("query_id", "id")
    near = vx.lsh_topk(queries, vec, k, width, skip_self=True).select("query_id", "id")
    return near.intersect(exact).count() / exact.count()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_lsh_recall_of_the_default_parameters(spark, folder):
    points = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    vec = points.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    assert default_recall(vec.select(F.col("id").alias("query_id"), "vector"), vec, 10, 64) >= 0.9


@pytest.mark.parametrize("n", [1000, 8000])
def test_lsh_recall_where_buckets_save_work(spark, n):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((n // 20, 16))
    rows = np.repeat(groups, 20, axis=0) + 0.25 * rng.standard_normal((n, 16))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], ["id", "vector"]).repartition(4)
    queries = vec.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    tables, bits = vx._lsh_shape(queries, vec, 10, 16, None, None, 42, True)
    assert tables < 1 << bits
    assert default_recall(queries, vec, 10, 16) >= 0.9


def test_row_cosine_and_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], ["a", "b"])
    unit = df.select(vx.l2_normalised(F.col("a")).alias("u")).collect()
    assert unit[0]["u"] == [0.6, 0.8] and unit[1]["u"] == [0.0, 0.0]
    scores = [r["c"] for r in df.select(vx.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(scores[0] - 0.96) < 1e-12 and scores[1] == 0.0


def test_null_vectors_take_no_part_and_widths_must_agree(spark):
    data, queries, vec = frames(spark, n=90, q=10)
    null = spark.createDataFrame([(None,), (None,)], "vector array<double>")
    more_q = queries.unionByName(null.select(F.lit(900).cast("long").alias("query_id"), "vector"))
    more_v = vec.unionByName(null.select(F.lit(901).cast("long").alias("id"), "vector"))
    for limit in (10**6, 0):
        got = vx.cosine_topk(more_q, more_v, 5, broadcast_values=limit, block_values=90)
        assert collected(got) == brute(data, 10, 5, False)
    ragged = vec.unionByName(spark.createDataFrame([(902, [1.0, 2.0])], vec.schema))
    with pytest.raises(Exception, match="different widths"):
        vx.cosine_topk(queries, ragged, 5).collect()


@pytest.mark.parametrize("limit", [10**6, 90])
def test_tagged_search_equals_separate_searches(spark, limit):
    data, queries, vec = frames(spark, n=120, q=12)
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    tagged = vec.withColumn("tags", tags)
    names = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("none")))
    asked = queries.withColumn("tag", F.explode(names))
    got = vx.tagged_topk(asked, tagged, {"a": 3, "b": 5}, broadcast_values=limit)
    for tag, k in (("a", 3), ("b", 5)):
        apart = vx.cosine_topk(asked.where(F.col("tag") == tag), tagged.where(F.array_contains("tags", tag)), k)
        rows = got.where(F.col("tag") == tag).drop("tag")
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, apart.collect()))
    assert got.where("tag = 'none'").count() == 0
    assert vx.tagged_topk(asked.limit(0), tagged, {"a": 3}).collect() == []


def test_best_of_a_wide_block_with_ties_and_no_numbers():
    rng = np.random.default_rng(3)
    data = rng.integers(-2, 3, (5000, 6)).astype(float)  # many equal scores
    data[7] = np.nan
    units = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
    ids, k = pa.array(np.arange(5000)), 9
    query, found, score = vx._block_best(ids.slice(0, 40), units[:40], ids, units, k, True)
    for q in range(40):
        scores = np.round(units @ units[q], vx.SCORE_DIGITS)
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q and not np.isnan(s))[:k]
        mine = query == q
        assert [(-s, i) for s, i in zip(score[mine], found.to_numpy()[mine])] == want


def ranks(df):
    return {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}


def test_dealt_queries_equal_brute_force(spark, monkeypatch):
    data, queries, vec = frames(spark, q=300)
    expected = {row[:3] for row in brute(data, 300, 12, True)}
    monkeypatch.setattr(vx, "TASK_PAIRS", 9000)
    monkeypatch.setattr(vx, "TASK_QUERIES", 40)
    blocks = vx.cosine_topk(queries, vec, 12, True, broadcast_values=0, block_values=500)  # five blocks
    assert ranks(blocks) == expected
    monkeypatch.setattr(vx, "MANY_QUERIES", 10)
    assert ranks(vx.cosine_topk(queries, vec, 12, True)) == expected
    assert vx.cosine_topk(queries, vec.limit(0), 12, broadcast_values=0).collect() == []
    monkeypatch.setattr(vx, "SENT_BLOCKS", 0)
    assert ranks(vx.cosine_topk(queries, vec, 12, True, broadcast_values=0, block_values=500)) == expected


def test_many_queries_are_shared_by_tasks(spark, monkeypatch):
    """However few files the vectors come in: their partitions do not bound the tasks."""
    data, queries, vec = frames(spark, q=300)
    monkeypatch.setattr(vx, "MANY_QUERIES", 10)
    monkeypatch.setattr(vx, "TASK_PAIRS", 9000)
    monkeypatch.setattr(vx, "TASK_QUERIES", 40)
    near = vx.cosine_topk(queries.coalesce(1), vec.coalesce(1), 3, True)
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()
    assert ranks(near) == {row[:3] for row in brute(data, 300, 3, True)}


def test_single_precision_loses_no_candidate(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal(40) + 1e-6 * rng.standard_normal((3000, 40))  # scores differ beyond single precision
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    ids = pa.array([f"k{i:04d}" for i in range(3000)])
    query, found, score = vx._block_best(ids.slice(0, 30), units[:30], ids, units, 4, True)
    for q in range(30):
        want = sorted((-s, f"k{i:04d}") for i, s in enumerate(np.round(units @ units[q], vx.SCORE_DIGITS)) if i != q)[:4]
        assert [(-s, i) for s, i in zip(score[query == q], found.take(pa.array(np.flatnonzero(query == q))).to_pylist())] == want
