"""Name search against direct comparison of all pairs."""

import random
import re

from pyspark.sql import functions as F

from lexgrove.operators import names as nm

WORDS = ["Cà", "phê", "Coffee", "VN", "ABC", "abc", "Việt", "tea", "Te", "a", "B-12", "O'Neil"]


def frames(spark, n=80, seed=2):
    rng = random.Random(seed)
    register = [
        (i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))), rng.choice([[], ["1"], ["2", "3"]]))
        for i in range(n)
    ]
    register += [(1000 + i, "Coffee VN", ["1"]) for i in range(40)]  # one name with many copies
    queries = [(i, w) for i, w in enumerate(["coffee", "te", "a", "zzz", "Coffee VN", "cà phê việt", "B-12"])]
    reg = spark.createDataFrame(register, "key int, name string, classes array<string>").repartition(4)
    return register, queries, reg, spark.createDataFrame(queries, "query_id int, name string")


def grams(name):
    words = [w for w in re.split(r"[^\w]+|_", name.lower()) if w]
    return {("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)}


def brute_contains(register, query, limit):
    rows = [(r[1].lower() != query.lower(), r[1], r[0]) for r in register if query.lower() in r[1].lower()]
    return [(k, n, 0.8 if d else 1.0) for d, n, k in sorted(rows)[:limit]]


def brute_fuzzy(register, query, limit):
    g, rows = grams(query), []
    for key, name, _ in register:
        h = grams(name)
        s = len(g & h) / len(g | h) if g | h else 0.0
        if s > 0.15:
            rows.append((-s, name, key))
    return [(k, n, round(min(-s, 0.95), 4)) for s, n, k in sorted(rows)[:limit]]


def got(df, query_id):
    rows = df.where(F.col("query_id") == query_id).orderBy("rank").collect()
    return [(r["key"], r["name"], r["score"]) for r in rows]


def test_tiers_equal_all_pairs(spark):
    register, queries, reg, asked = frames(spark)
    for parts in (nm.GRAM_PART_ROWS, 3):
        contains = nm.contains_tier(asked, reg, 20).cache()
        by_gram = nm.contains_tier(asked, reg, 20, part_rows=parts, scan_queries=0).cache()
        fuzzy = nm.fuzzy_tier(asked, reg, 20, part_rows=parts).cache()
        joined = nm.fuzzy_tier(asked, reg, 20, part_rows=parts, broadcast_grams=0).cache()
        few = nm.fuzzy_tier(
            asked, reg, 3, part_rows=parts, first_threshold=0.3, ladder_rows=0, broadcast_grams=0
        ).cache()
        for query_id, name in queries:
            assert got(contains, query_id) == brute_contains(register, name, 20), name
            assert got(by_gram, query_id) == brute_contains(register, name, 20), name
            assert got(fuzzy, query_id) == brute_fuzzy(register, name, 20), name
            assert got(joined, query_id) == brute_fuzzy(register, name, 20), name
            assert got(few, query_id) == brute_fuzzy(register, name, 3), name


def test_similarity_is_symmetric_and_one_on_equal(spark):
    register, _, reg, _ = frames(spark)
    asked = reg.select(F.lower("name").alias("query_id"), "name").distinct().dropDuplicates(["query_id"])
    pairs = nm.similar_pairs(asked, reg, part_rows=5)
    assert pairs.count() == pairs.select("query_id", "lower_name").distinct().count()
    swapped = pairs.select(F.col("lower_name").alias("query_id"), F.col("query_id").alias("lower_name"), "similarity")
    assert pairs.exceptAll(swapped).count() == 0
    assert pairs.where("query_id = lower_name and similarity <> 1").count() == 0
    names = {r[1].lower() for r in register}
    expected = {
        (a, b) for a in names for b in names if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.15
    }
    assert {(r["query_id"], r["lower_name"]) for r in pairs.collect()} == expected


def test_wildcards(spark):
    reg = spark.createDataFrame([(1, "abc"), (2, "axc"), (3, "ab%c")], "key int, name string")
    asked = spark.createDataFrame([(1, "a_c"), (2, "b%c"), (3, "%")], "query_id int, name string")
    for limit in (0, 100):
        hits = nm.contains_tier(asked, reg, wildcards=True, scan_queries=limit)
        wild = hits.groupBy("query_id").agg(F.sort_array(F.collect_list("key")).alias("k"))
        assert {r["query_id"]: r["k"] for r in wild.collect()} == {1: [1, 2], 2: [1, 3], 3: [1, 2, 3]}
    plain = nm.contains_tier(asked, reg).select("query_id", "key").collect()
    assert {tuple(r) for r in plain} == {(2, 3), (3, 3)}


def test_both_ways_on_signs_that_patterns_use(spark):
    names = ["a\\b", "a%b", "a_b", "axb", "a\nb", "\\", "%", "A\\B c", "tab\there"]
    reg = spark.createDataFrame(list(enumerate(names)), "key int, name string")
    asked = spark.createDataFrame(list(enumerate(["a\\b", "\\", "a%b", "a_b", "\n", "_\\", "\\%", "b"])), "query_id int, name string")
    for wildcards in (False, True):
        scan, join = (
            sorted((r["query_id"], r["key"]) for r in nm.contains_tier(asked, reg, wildcards=wildcards, scan_queries=n).collect())
            for n in (100, 0)
        )
        expected = []
        for i, q in enumerate(r["name"] for r in asked.orderBy("query_id").collect()):
            like = re.escape(q.lower()).replace("%", ".*").replace("_", ".") if wildcards else re.escape(q.lower())
            expected += [(i, k) for k, n in enumerate(names) if re.search(like, n.lower(), re.DOTALL)]
        assert scan == join == sorted(expected)


def test_merged_search(spark):
    register, queries, reg, asked = frames(spark)
    limit = 20
    result = nm.search(asked, reg, limit).cache()
    for query_id, name in queries:
        seen = {}
        for key, n, score in brute_contains(register, name, limit) + brute_fuzzy(register, name, limit):
            if key not in seen or score > seen[key][2]:
                seen[key] = (key, n, score)
        expected = sorted(seen.values(), key=lambda m: -m[2])[:limit]
        assert got(result, query_id) == expected, name


def test_class_filter(spark):
    register, _, reg, asked = frames(spark)
    wanting = asked.withColumn("classes", F.array(F.lit("2")))
    kept = nm.search(wanting, reg).collect()
    assert kept and all(not r["classes"] or "2" in r["classes"] for r in kept)
    first = nm.search(asked, reg, limit=5, only_classes=["2"]).collect()
    assert len(first) > 5 and all(not r["classes"] or "2" in r["classes"] for r in first)
    plain = nm.search(asked.withColumn("classes", F.lit(None).cast("array<string>")), reg)
    assert plain.count() == nm.search(asked, reg).count()


def test_rows_without_key_are_dropped(spark):
    reg = spark.createDataFrame([("", "abc"), ("k", "abc")], "key string, name string")
    asked = spark.createDataFrame([(1, "abc")], "query_id int, name string")
    assert [r["key"] for r in nm.search(asked, reg).collect()] == ["k"]


def test_copies_are_cut_before_they_meet_queries(spark):
    register = spark.range(3000).select(F.col("id").alias("key"), F.lit("tea VN").alias("name"), F.lit("x").alias("more"))
    queries = spark.createDataFrame([(i, "tea VN") for i in range(30)], "query_id int, name string")
    for tier in (nm.contains_tier, nm.fuzzy_tier):
        found = tier(queries, register, limit=3)
        assert "_copy" in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["query_id"], r["key"], r["rank"]) for r in found.collect()} == {(q, k, k + 1) for q in range(30) for k in range(3)}
