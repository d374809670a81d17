from pyspark.sql import functions as F

from lexgrove.functions import records
from lexgrove.operators import merge as mg
from lexgrove.operators.profile import merge_report
from lexgrove.plans.sheet_merge import merge_records


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_owner_classes_dates(spark):
    df = spark.createDataFrame(
        [(" X (Korea (Republic of)) ", "9, 11;35 x 9", "Registered (March 19, 1998)"), ("Y", None, "Ended"), (None, "", None)],
        "o string, c string, s string",
    )
    name, country = records.owner_parts(F.col("o"))
    got = df.select(name.alias("n"), country.alias("k"), records.class_list(F.col("c")).alias("c"), records.status_date(F.col("s")).alias("d")).collect()
    assert [tuple(r) for r in got] == [
        ("X (Korea", "Republic of", ["9", "11", "35", "9"], "March 19, 1998"), ("Y", "", [], None), ("", "", [], None),
    ]


def test_keyed_merges(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, a string, b string")
    source = spark.createDataFrame(
        [(1, "c", None, 1), (1, None, "z", 2), (3, "n", None, 3)], "k int, a string, b string, o int"
    )
    over = mg.merge_overwrite(target, source, ["k"], ["o"])
    assert rows(over, "k", "a", "b") == [(1, None, "z"), (2, "b", "y"), (3, "n", None)]
    fill = mg.merge_coalesce(target, source, ["k"], ["o"])
    assert rows(fill, "k", "a", "b") == [(1, "c", "z"), (2, "b", "y"), (3, "n", None)]
    for merge, once in ((mg.merge_overwrite, over), (mg.merge_coalesce, fill)):
        assert rows(merge(once, source, ["k"], ["o"]), "k", "a", "b") == rows(once, "k", "a", "b")


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k int, o int, v string")
    assert rows(mg.first_by(df, ["k"], ["o"]), "k", "v") == [(1, "a"), (2, "b")]
    assert rows(mg.last_by(df, ["k"], ["o"]), "k", "v") == [(1, None), (2, "b")]
    keyless = spark.createDataFrame([("", 1), (None, 2), ("s", 3), ("s", 4)], "k string, o int")
    assert sorted(r["o"] for r in mg.dedupe_first(keyless, "k", ["o"]).collect()) == [1, 2, 3]


def test_links_and_retention(spark):
    df = spark.createDataFrame([(1, ["9", "9", "3"]), (2, [])], "k int, cs array<string>")
    links = mg.bridge(df, "k", "cs", "c")
    more = mg.extend_links(links, spark.createDataFrame([(1, "9"), (2, "5")], "k int, c string"))
    assert rows(more, "k", "c") == [(1, "3"), (1, "9"), (2, "5")]
    assert rows(mg.classes_of(more, "k", "c"), "k", "cs") == [(1, ["3", "9"]), (2, ["5"])]
    assert mg.dimension(more, "c").count() == 3
    tokens = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, e int")
    assert rows(mg.unexpired(tokens, "e", F.lit(9)), "id") == [(2,), (3,)]
    assert mg.expired_count(tokens, "e", F.lit(9)).first()["removed"] == 1


def test_resume_and_cascade(spark):
    work = spark.createDataFrame([(x,) for x in ("a", "ab", "abc", "b", "bc", "c")], "p string")
    done = spark.createDataFrame([("ab",), ("c",)], "p string")
    assert rows(mg.not_yet_done(work, done, "p"), "p") == [("a",), ("abc",), ("b",), ("bc",)]
    assert rows(mg.not_yet_done(work, done, "p", by_prefix=4), "p") == [("a",), ("b",), ("bc",)]
    parents = spark.createDataFrame([(1,), (2,)], "s int")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "s int, m string")
    left, messages = mg.cascade_delete(parents, children, spark.createDataFrame([(1,)], "s int"), "s")
    assert rows(left, "s") == [(2,)] and rows(messages, "m") == [("z",)]


def test_trademark_upsert(spark):
    columns = ["brand_name", "st13", "registration_number", "status"]
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in mg.TRADEMARK_FIELDS))
    first = spark.createDataFrame(
        [(1, "A", "S1", "R1", "old"), (2, "A2", "S1", "R1", None), (3, "B", None, "R2", "x"), (4, " ", "S9", "R9", "x"),
         (5, "C", None, None, "x"), (6, "D", "S2", "R1", "d")],
        "row int, brand_name string, st13 string, registration_number string, status string",
    )
    merged, ambiguous = mg.trademark_upsert(empty, first, "row")
    assert rows(merged, *columns) == [("A2", "S1", "R1", None), ("B", None, "R2", "x"), ("D", "S2", "R1", "d")]
    assert ambiguous.count() == 0
    second = spark.createDataFrame(
        [(1, "E", None, "R1", "new"), (2, "F", None, "R2", None), (3, "F", None, "R2", "y")],
        "row int, brand_name string, st13 string, registration_number string, status string",
    )
    again, ambiguous = mg.trademark_upsert(merged, second, "row")
    assert rows(again, *columns) == [("D", "S2", "R1", "d"), ("E", "S1", "R1", "new"), ("F", None, "R2", "y")]
    assert rows(ambiguous, "registration_number", "rows") == [("R1", 2)]


def test_sheet_merge_report(spark):
    recs = spark.createDataFrame(
        [("b", 1, "N", "S", "VN"), ("a", 9, "M", "S", "US"), ("a", 2, "K", "", "VN"), ("a", 3, "L", "", "VN")],
        "file string, row int, brand_name string, st13 string, ip_office string",
    )
    unique, report = merge_records(recs, ["file", "row"])
    assert rows(unique, "brand_name") == [("K",), ("L",), ("M",)]
    assert tuple(report.first()) == (3, 2, 1)
    assert merge_report(recs, recs).first()["duplicates"] == 0
