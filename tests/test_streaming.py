import datetime
import random

from lexgrove.operators.merge import TRADEMARK_FIELDS
from lexgrove.streaming import incremental as inc
from lexgrove.streaming import log


def test_incremental_statutes(spark, tmp_path):
    src, log, point = (str(tmp_path / n) for n in ("src", "log", "checkpoint"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("Luật số: 1/2000/QH\nĐiều 1. Tên gọi\nmột", encoding="utf-8")
    inc.ingest_statutes(spark, src, log, point).awaitTermination()
    first = inc.current_chunks(spark, log)
    assert first.count() == 1 and first.first()["doc_id"] == "1/2000/QH"
    (tmp_path / "src/b.txt").write_text("Điều 2. Khác\nhai", encoding="utf-8")
    inc.ingest_statutes(spark, src, log, point).awaitTermination()
    both = inc.current_chunks(spark, log)
    assert both.count() == 2
    inc.ingest_statutes(spark, src, log, point).awaitTermination()  # nothing new
    assert inc.current_chunks(spark, log).exceptAll(both).count() == 0


def test_incremental_trademarks(spark, tmp_path):
    src, log, point = (str(tmp_path / n) for n in ("src", "log", "checkpoint"))
    schema = "row int, brand_name string, st13 string, registration_number string, status string"
    spark.createDataFrame([(1, "A", "S1", "R1", "x"), (2, "B", None, "R2", "y")], schema).write.parquet(src)
    run = lambda: inc.start_log(spark.readStream.schema(schema).parquet(src), log, point).awaitTermination()
    run()
    spark.createDataFrame([(1, "C", "S1", None, None), (2, "D", None, "R2", None)], schema).write.mode("append").parquet(src)
    run()
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in TRADEMARK_FIELDS))
    merged, ambiguous = inc.current_trademarks(spark, log, empty)
    got = {(r["brand_name"], r["st13"], r["registration_number"], r["status"]) for r in merged.collect()}
    assert got == {("C", "S1", None, None), ("D", None, "R2", "y")} and ambiguous.count() == 0


def test_daily_activity_with_late_days(spark, tmp_path):
    src, log, point = (str(tmp_path / n) for n in ("src", "log", "checkpoint"))
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    assert inc.current_days(spark, log).collect() == []
    arrivals = [[(1, day(9)), (2, day(9, 5)), (3, day(12))], [(4, day(1)), (5, day(9, 7))], [(6, day(1, 3)), (7, None)]]
    for rows in arrivals:
        spark.createDataFrame(rows, "i int, ts timestamp").write.mode("append").parquet(src)
        stream = spark.readStream.schema("i int, ts timestamp").parquet(src)
        inc.log_daily_activity(stream, "ts", log, point).awaitTermination()
    got = {r["day"] and r["day"].day: r["visits"] for r in inc.current_days(spark, log).collect()}
    assert got == {1: 2, 9: 3, 12: 1, None: 1}


def test_rolling_messages(spark, tmp_path):
    src, log, point = (str(tmp_path / n) for n in ("src", "log", "checkpoint"))
    rows = [(1, i, f"m{i}") for i in range(9)] + [(2, 0, "x"), (2, 0, None), (None, 1, "n")]
    df = spark.createDataFrame(rows, "s int, t int, c string")
    assert inc.current_messages(spark, log, "s", "t", "c", 3, "s int, t long, c string").count() == 0

    def arrive(part):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema("s int, t int, c string").parquet(src)
        inc.log_last_messages(stream, "s", "t", "c", log, point, 3).awaitTermination()
        rows = inc.current_messages(spark, log, "s", "t", "c", 3).collect()
        return {r["s"]: (r["orders"], r["contents"]) for r in rows}

    seen = arrive(df.where("t % 2 = 0"))
    assert seen[1] == ([4, 6, 8], ["m4", "m6", "m8"]) and sorted(seen[2][1], key=str) == [None, "x"]
    seen = arrive(df.where("t % 2 = 1"))  # older messages of the same session
    assert seen[1] == ([6, 7, 8], ["m6", "m7", "m8"]) and seen[None] == ([1], ["n"])


def logged(spark, path, number, rows, schema):
    log.batch_writer(str(path))(spark.createDataFrame(rows, schema), number)


def test_compaction_leaves_results_as_they_are(spark, tmp_path):
    rng, path, plain = random.Random(4), str(tmp_path / "log"), str(tmp_path / "plain")
    schema = "row int, brand_name string, st13 string, registration_number string, status string"
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in TRADEMARK_FIELDS))
    pick = lambda *values: rng.choice(values)
    for number in range(5):
        rows = [(i, pick("A", "B", "C", None), pick(None, None, "S1", "S2", "S3"), pick("R1", "R2", "R3", None), pick("x", "y", None)) for i in range(8)]
        for folder in (path, plain):
            logged(spark, folder, number, rows, schema)
        if number in (1, 3):
            found = log.compact(spark, path, inc.latest_records)
            assert found.up_to == number and log.compact(spark, path, inc.latest_records) is None
            if number == 3:
                assert len(log.sweep(spark, path)) == 5  # four batches and the first snapshot
        for whole, compacted in zip(inc.current_trademarks(spark, plain, empty), inc.current_trademarks(spark, path, empty)):
            assert sorted(map(repr, whole.collect())) == sorted(map(repr, compacted.collect()))


def test_compaction_of_other_logs(spark, tmp_path):
    days, talk = str(tmp_path / "days"), str(tmp_path / "talk")
    for number in range(3):
        logged(spark, days, number, [(datetime.date(2024, 1, d), d + number) for d in range(1, 4)], "day date, visits long")
        logged(spark, talk, number, [(s, t, f"{number}") for s in (1, 2) for t in range(number, 5)], "s int, t long, c string")
    rows = lambda: (
        sorted(map(tuple, inc.current_days(spark, days).collect())), sorted(map(repr, inc.current_messages(spark, talk, "s", "t", "c", 3).collect()))
    )
    before = rows()
    assert log.compact(spark, days, inc.summed_days) and log.compact(spark, talk, lambda r: inc.latest_messages(r, "s", "t", "c", 3))
    assert rows() == before
    log.sweep(spark, days)
    log.sweep(spark, talk)
    assert rows() == before


def test_an_unfinished_batch_is_not_compacted(spark, tmp_path):
    path = tmp_path / "log"
    for number in range(2):
        logged(spark, path, number, [(datetime.date(2024, 1, 1), 1)], "day date, visits long")
    (path / "batch_id=1" / "_SUCCESS").unlink()
    assert log.compact(spark, str(path), inc.summed_days).up_to == 0
    assert inc.current_days(spark, str(path)).first()["visits"] == 2
    assert log.compact(spark, str(tmp_path / "nothing"), inc.summed_days) is None and log.sweep(spark, str(tmp_path / "nothing")) == []


def test_stream_of_a_table_in_one_file_or_a_folder(spark, tmp_path):
    from lexgrove.plans import bindings

    rows = [(i, f"a{i}\nb{i}", "en", "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    (tmp_path / "one").mkdir()
    docs.toPandas().to_parquet(tmp_path / "one/documents.parquet")
    for folder in ("many", "one"):
        got = bindings.stream_chunks(spark, str(tmp_path / folder)).collect()
        assert {(r["doc_id"], r["content"]) for r in got} == {(i, f"{c}{i}") for i in range(6) for c in "ab"}
