import datetime

from pyspark.sql import functions as F

from lexgrove.operators import lines, profile, sampling


def test_null_profile_and_types(spark):
    df = spark.createDataFrame([(1, None, "a")] * 2 + [(2, "x", None)] * 8, "i int, p string, t string")
    got = {r["column_name"]: (r["nulls"], r["not_nulls"], r["null_pct"], r["level"]) for r in profile.null_profile(df, ["i", "p", "t"]).collect()}
    assert got == {"i": (0, 10, 0.0, "ok"), "p": (2, 8, 20.0, "warn"), "t": (8, 2, 80.0, "bad")}
    counts = {(r["dimension"], r["value"]): (r["rows"], r["pct"]) for r in profile.type_counts(df, ["i", "t"]).collect()}
    assert counts == {("i", "1"): (2, 20.0), ("i", "2"): (8, 80.0), ("t", "a"): (2, 20.0), ("t", "unknown"): (8, 80.0)}


def test_counts_series_page(spark):
    days = [datetime.datetime(2024, 1, d, 5) for d in (1, 3, 3, 9)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(days)], "i int, ts timestamp")
    series = profile.daily_series(df, "ts", {"n": F.count(F.lit(1))}).orderBy("day").collect()
    assert [r["n"] for r in series] == [2, 0, 0, 0, 0, 0, 1] and series[0]["day"] == datetime.date(2024, 1, 3)
    stats = {r["metric"]: r["value"] for r in profile.counts_of({"all": df, "late": (df, F.col("i") > 1)}).collect()}
    assert stats == {"all": 4, "late": 2}
    page = profile.page(df, [F.col("i").desc()], 1, 2).collect()
    assert [(r["i"], r["total"]) for r in page] == [(2, 4), (1, 4)]


def test_prefix_plan_covers_every_name(spark):
    names = ["ab"] * 3 + ["abc"] * 4 + ["abcde"] * 9 + ["b", "c", "Cd"] + ["d"] * 5 + [None, "", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = {(r["prefix"], r["kind"]): r["rows"] for r in profile.prefix_plan(df, "n", cap=4, depth=4).collect()}
    assert rows == {("ab", "ends"): 3, ("abc", "ends"): 4, ("abcd", "overflow"): 9, ("b", "leaf"): 1, ("c", "leaf"): 2, ("d", "ends"): 5, ("", "null"): 1, ("", "empty"): 2}
    assert sum(rows.values()) == len(names)


def test_prefix_plan_goes_on_until_all_fit(spark):
    names = ["abcdefgh"] * 9 + ["abcdefgi"] * 3 + ["abcdefg"] * 2 + ["ABCx"] * 2 + ["zz"] * 20 + [None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = {(r["prefix"], r["kind"]): r["rows"] for r in profile.prefix_plan(df, "n", cap=4, depth=None).collect()}
    assert rows == {
        ("abcdefgh", "ends"): 9, ("abcdefgi", "leaf"): 3, ("abcdefg", "ends"): 2, ("abcx", "leaf"): 2, ("zz", "ends"): 20, ("", "null"): 1
    }
    assert profile.prefix_plan(df.limit(0), "n", depth=None).collect() == []


def test_seeded_order_is_total_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    a = sampling.seeded_positions(df, "k", 42)
    assert a.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (1, 5000, 5000)
    b = sampling.seeded_positions(df.repartition(9), "k", 42)
    assert a.exceptAll(b).count() == 0
    first = sampling.seeded_sample(df, "k", 42, 50)
    assert first.exceptAll(a).count() == 0 and first.count() == 50
    assert sampling.seeded_sample(df, "k", 43, 50).select("k").exceptAll(first.select("k")).count() > 0
    assert sampling.seeded_sample(df, "k", 42, 0).count() == 5000


def test_result_cards(spark):
    page = "\n".join(
        ["Results view", "Filters", "ABC COFFEE", "Owner", "Cong ty A (Viet Nam)", "Nice class", "30, 43", "35", "IPR", "Trademark",
         "Country of filing", "Viet Nam", "Status", "Registered (March 19, 1998)", "Number", "4-1998-1", "XYZ", "Owner", "B Co.",
         "Nice class", "9", "Number", "77", "Results per page"]
    )
    other = "\n".join(["No results", "Sort results"])
    df = spark.createDataFrame([(1, page), (2, other)], "page int, text string")
    rows = lines.lines_of(df, "page", F.col("text"))
    for width in (4, 100_000):
        got = {r["brand_name"]: r for r in lines.trademark_cards(rows, "page", width).collect()}
        assert set(got) == {"ABC COFFEE", "XYZ"}
        a, b = got["ABC COFFEE"], got["XYZ"]
        assert (a["owner_name"], a["owner_country"], a["nice_classes"]) == ("Cong ty A", "Viet Nam", ["30", "43", "35"])
        assert (a["status_date"], a["registration_number"], a["ipr_type"]) == ("March 19, 1998", "4-1998-1", "Trademark")
        assert (b["owner_name"], b["nice_classes"], b["registration_number"], b["status"]) == ("B Co.", ["9"], "77", None)
