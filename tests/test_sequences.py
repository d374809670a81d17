"""Segmented sequence operators against plain windows, with tiny segments."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexgrove.operators import sequences as sq


def frame(spark, seed=3):
    """One group with most rows, gaps in the order, nulls in the values."""
    rng = random.Random(seed)
    rows = []
    for group, n in ((1, 200), (2, 7), (3, 1)):
        for order in sorted(rng.sample(range(600), n)):
            value = rng.choice([None, None, None, f"v{order}"])
            rows.append((group, order, value, f"text {group}.{order}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g int, o int, v string, t string").repartition(4)


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_position_successor_carry(spark):
    df = frame(spark)
    w = Window.partitionBy("g").orderBy("o")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for width in (3, 50, 10_000):
        pos = sq.with_position(df, "g", "o", width).select("g", "o", F.col("position").cast("int"))
        same(pos, df.select("g", "o", (F.row_number().over(w) - 1).alias("position")))
        nxt = sq.with_successor(df, "g", "o", "t", "n", width).select("g", "o", "n")
        same(nxt, df.select("g", "o", F.lead("t").over(w).alias("n")))
        carried = sq.carry_forward(df, "g", "o", {"v": "last_v"}, width).select("g", "o", "last_v")
        same(carried, df.select("g", "o", F.last("v", True).over(running).alias("last_v")))


def test_null_groups_and_orders_keep_their_rows(spark):
    rows = [(g, o, v, f"t{g}.{o}") for g in (None, 1) for o, v in ((None, "n"), (0, None), (3, "a"), (9, None), (11, None))]
    df = spark.createDataFrame(rows, "g int, o int, v string, t string").repartition(3)
    w = Window.partitionBy("g").orderBy("o")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for width in (2, 4, 100):
        pos = sq.with_position(df, "g", "o", width).select("g", "o", F.col("position").cast("int"))
        same(pos, df.select("g", "o", (F.row_number().over(w) - 1).alias("position")))
        nxt = sq.with_successor(df, "g", "o", "t", "n", width).select("g", "o", "n")
        same(nxt, df.select("g", "o", F.lead("t").over(w).alias("n")))
        carried = sq.carry_forward(df, "g", "o", {"v": "last_v"}, width).select("g", "o", "last_v")
        same(carried, df.select("g", "o", F.last("v", True).over(running).alias("last_v")))


def test_edges_per_group(spark):
    df = frame(spark)
    edges = sq.next_edges(df, "g", "o", "t", width=5)
    assert edges.count() == df.count() - 3
    assert edges.where("g = 3").count() == 0


def test_context_windows(spark):
    df = sq.with_position(frame(spark), "g", "o", 5)
    hits = df.where("o % 3 = 0").select("g", "o", "position")
    w = Window.partitionBy("g").orderBy("o")
    for n in (1, 3):
        got = sq.context_of(hits, df, "g", "position", "t", n).select("g", "o", "context_before", "context_after")
        wb, wa = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
        joined = lambda rows: F.when(
            F.size(rows) > 0, F.concat(F.array_join(rows, "\n---\n"), F.lit("\n---\n"))
        )
        expected = df.select(
            "g", "o",
            joined(F.collect_list("t").over(wb)).alias("context_before"),
            joined(F.collect_list("t").over(wa)).alias("context_after"),
        ).where("o % 3 = 0")
        same(got, expected)
        bounded = sq.context_of(hits, df, "g", "position", "t", n, max_hits=1000)
        same(bounded.select(*got.columns), expected)
    none = sq.context_of(hits, df, "g", "position", "t", 0)
    assert none.where("context_before is not null").count() == 0


def test_last_n(spark):
    df = frame(spark)
    got = sq.last_n(df, "g", [F.col("o")], 5)
    w = Window.partitionBy("g").orderBy(F.col("o").desc())
    same(got, df.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r"))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
