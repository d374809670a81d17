import random

from pyspark.sql import functions as F

from lexgrove.operators import metrics as mt


def brute(retrieved, relevant, k):
    docs = list(dict.fromkeys(retrieved))
    found = len(set(docs[:k]) & relevant)
    rr = next((1 / (i + 1) for i, d in enumerate(docs) if d in relevant), 0.0)
    return found / k, (found / len(relevant) if relevant else 0.0), rr


def test_evaluate_equals_direct_computation(spark):
    rng = random.Random(4)
    qrels = {q: {rng.randint(0, 30) for _ in range(rng.randint(1, 6))} for q in range(30)}
    hits = {q: [rng.randint(0, 30) for _ in range(25)] for q in range(0, 28)}
    queries = spark.createDataFrame([(q, f"text {q}" if q != 3 else "") for q in range(30)], "query_id int, text string")
    pairs = spark.createDataFrame([(q, c) for q, cs in qrels.items() for c in cs] * 2, "query_id int, corpus_id int")
    ranked = spark.createDataFrame(
        [(q, i + 1, h) for q, hs in hits.items() for i, h in enumerate(hs)], "query_id int, rank int, id int"
    )
    means, per_query = mt.evaluate(queries, pairs, ranked, (1, 5, 20))
    got = {(r["query_id"], r["k"]): (r["precision"], r["recall"], r["reciprocal_rank"]) for r in per_query.collect()}
    known = [q for q in range(30) if q != 3]
    assert set(got) == {(q, k) for q in known for k in (1, 5, 20)}
    for (q, k), values in got.items():
        expected = brute(hits.get(q, []), qrels[q], k)
        assert all(abs(a - b) < 1e-12 for a, b in zip(values, expected)) and all(0 <= v <= 1 for v in values)
    for r in means.collect():
        expected = [sum(brute(hits.get(q, []), qrels[q], r["k"])[i] for q in known) / len(known) for i in range(3)]
        assert all(abs(a - b) < 1e-12 for a, b in zip((r["precision"], r["recall"], r["mrr"]), expected))
    assert not mt.looks_unmatched(means).first()["all_zero"]
    record = mt.as_record(per_query).where("query_id = 0").first()
    assert set(record["precision"]) == {1, 5, 20}
    limited, _ = mt.evaluate(queries, pairs, ranked, (1,), limit=4)
    assert limited.first()["queries"] == 4


def test_no_queries_give_zero(spark):
    queries = spark.createDataFrame([], "query_id int, text string")
    qrels = spark.createDataFrame([], "query_id int, corpus_id int")
    hits = spark.createDataFrame([], "query_id int, rank int, id int")
    means, _ = mt.evaluate(queries, qrels, hits, (1, 3))
    assert [tuple(r) for r in means.orderBy("k").collect()] == [(1, 0.0, 0.0, 0.0, 0), (3, 0.0, 0.0, 0.0, 0)]
    assert mt.looks_unmatched(means).first()["all_zero"]


def test_dedupe_keeps_first_rank(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "c")], "query_id int, rank int, id string")
    got = mt.dedupe_ranked(hits).orderBy("rank").select("id", "rank").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("b", 2), ("c", 3)]
    assert mt.dedupe_ranked(hits).where(F.col("rank") > 3).count() == 0


def test_result_is_written_with_its_settings(spark, tmp_path):
    from lexgrove.sources import writers

    q = spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, text string")
    rel = spark.createDataFrame([("a", "1"), ("b", "2")], "query_id string, corpus_id string")
    hits = spark.createDataFrame([("a", 1, "1"), ("b", 1, "3"), ("b", 2, "2")], "query_id string, rank int, id string")
    means, per_query = mt.evaluate(q, rel, hits, ks=(1, 3))
    folder = str(tmp_path / "run")
    writers.evaluation_result(means, per_query, folder, {"searcher": "exact", "seconds": 1.5})
    rows = spark.read.json(f"{folder}/aggregate.json").orderBy("k").collect()
    assert [(r.searcher, r.seconds, r.k, r.precision, r.recall) for r in rows][0] == ("exact", 1.5, 1, 0.5, 0.5)
    each = {r.query_id: r for r in spark.read.json(f"{folder}/per_query.json").collect()}
    assert each["a"].mrr == 1.0 and each["b"].mrr == 0.5 and each["b"].recall["1"] == 0.0 and each["b"].recall["3"] == 1.0
    try:
        writers.evaluation_result(means, per_query, folder, {"k": 1})
    except ValueError:
        pass
    else:
        raise AssertionError("a clash must be refused")


def test_only_hits_of_evaluated_queries_are_sorted(spark):
    queries = spark.createDataFrame([(i, "t", "a") for i in range(10)], "query_id int, text string, label string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "id int, label string")
    hits = spark.createDataFrame([(q, r, (q + r) % 10) for q in range(10) for r in (1, 2)], "query_id int, rank int, id int")
    means, each = mt.evaluate_by_label(queries, labels, hits, (1, 2), limit=3)
    assert "LeftSemi" in each._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["precision"], r["queries"]) for r in means.collect()}
    assert round(got[1][0], 6) == round(2 / 3, 6) and got[2] == (0.5, 3)
