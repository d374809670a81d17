import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove import schemas
from lexgrove.functions import corpus_ids
from lexgrove.operators import chunking, encode, graph
from lexgrove.operators.merge import first_by
from lexgrove.plans import evaluation_set
from lexgrove.sources import readers, writers


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Điều 1\nx", encoding="utf-8")
    (tmp_path / "b.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "c.md").write_text("no", encoding="utf-8")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path)).collect()] == [("a.txt", "Điều 1\nx")]


def test_chunk_file_round_trip(spark, tmp_path):
    rows = [{"content": "x", "metadata": {"title": "t", "chunk_index": 3, "is_continuation": True, "dieu": None}}]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=1), encoding="utf-8")
    read = readers.chunk_file(spark, str(tmp_path / "c.json"), schemas.STATUTE_METADATA)
    assert (read.first()["title"], read.first()["chunk_index"], read.first()["dieu"]) == ("t", 3, None)
    out = str(tmp_path / "out")
    writers.chunk_file(read, out, schemas.STATUTE_METADATA.fieldNames())
    again = readers.chunk_lines(spark, out, schemas.STATUTE_METADATA)
    assert again.exceptAll(read).count() == 0 and again.count() == 1


def test_chunk_lines_round_trip_over_many_rows_and_files(spark, tmp_path):
    schema = schemas.STATUTE_METADATA
    one = spark.createDataFrame([(f"line one\nline {i}", f"t{i}", i) for i in range(23)], "content string, title string, chunk_index int")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in one.columns]
    rows = one.select("*", *empty).select("content", *schema.fieldNames()).repartition(4)
    writers.chunk_file(rows, str(tmp_path / "out"), schema.fieldNames())
    again = readers.chunk_lines(spark, str(tmp_path / "out"), schema)
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert again.count() == 23 and {tuple(r) for r in again.select("content", "chunk_index").collect()} == {
        (f"line one\nline {i}", i) for i in range(23)
    }


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "queries.jsonl").write_text('{"_id": "1", "text": "a"}\n\n{"_id": "2", "text": ""}\n')
    (tmp_path / "qrels/test.jsonl").write_text(
        '{"query-id": "1", "corpus-id": "d+5", "score": 1}\n\n{"query-id": "1", "corpus-id": "d+5", "score": 1}\n'
    )
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d+5", "title": "Điều 5. Tên", "text": "t"}\n{"_id": "e+1"}\n{"_id": "plain", "title": "T"}\n')
    queries, qrels = readers.evaluation_set(spark, str(tmp_path))
    assert queries.count() == 2 and [tuple(r) for r in qrels.collect()] == [("1", "d+5")]
    assert readers.evaluation_corpus(spark, str(tmp_path), qrels).count() == 1
    rows = graph.evaluation_rows(readers.evaluation_corpus(spark, str(tmp_path)))
    got = {r["chunk_id"]: (r["doc_number"], r["dieu"], r["dieu_title"], r["content"]) for r in rows.collect()}
    assert got == {"d+5": ("d", "Điều 5", "Tên", "t"), "e+1": ("e", "Điều 1", "", ""), "plain": ("plain", None, "T", "")}
    assert graph.evaluation_documents(rows, "benchmark").count() == 3
    index = {r["chunk_id"]: r["chunk_index"] for r in graph.evaluation_chunks(rows).collect()}
    assert index["d+5"] == 160 and index["plain"] == 0


def test_corpus_ids(spark):
    df = spark.createDataFrame([(" 100/2019/NĐ-CP ", "Điều 5A"), ("", "Điều 1"), ("a b", "không")], "n string, d string")
    got = [r[0] for r in df.select(corpus_ids.corpus_id(F.col("n"), F.col("d"))).collect()]
    assert got == ["100/2019/nđ-cp+5a", None, None]
    parts = corpus_ids.parse_corpus_id(F.lit("a+b+7"), F.lit("x"))
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert tuple(row) == ("a+b", "Điều 7", "x")


def test_sheets(spark, tmp_path):
    head = "Brand name,Owner,ST13,Nice classification,Unknown,IP office\n"
    (tmp_path / "b.csv").write_text(head + "B,O (VN),S1,\"9, 11\",u,VN\n,,,,,\nC,,,5 x\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text(head + "A,P,S1,3,u,US\n", encoding="utf-8")
    got = readers.sheets(spark, str(tmp_path))
    rows = {r["brand_name"]: r for r in got.collect()}
    assert set(rows) == {"A", "B", "C"} and "Unknown" not in got.columns
    assert (rows["B"]["owner_name"], rows["B"]["owner_country"], rows["B"]["nice_classes"]) == ("O", "VN", ["9", "11"])
    assert (rows["C"]["st13"], rows["C"]["nice_classes"], rows["C"]["ip_office"]) == ("", ["5"], "")
    assert first_by(got.where("st13 = 'S1'").select("st13", "file", "row", "brand_name"), ["st13"], ["file", "row"]).first()["brand_name"] == "A"


def test_sidecar_overrides(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"filename": "a", "effective_date": "2001-01-01"}, {"filename": "a", "status": "old"}, {"status": "x"}]}))
    sidecar = readers.effective_dates(spark, str(tmp_path / "d.json"))
    assert sidecar.count() == 1
    docs = spark.createDataFrame([("a", "2000-01-01", "active"), ("b", None, "active")], "filename string, effective_date string, status string")
    got = {r["filename"]: (r["effective_date"], r["status"]) for r in readers.with_overrides(docs, sidecar).collect()}
    assert got == {"a": ("2000-01-01", "old"), "b": (None, "active")}


def test_trademark_records_and_points(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"brand_name": "A", "nice_classes": ["1"], "other": 1}, {"st13": "S"}]))
    got = readers.trademark_records(spark, str(tmp_path / "t.json")).collect()
    assert got[0]["nice_classes"] == ["1"] and got[1]["brand_name"] is None
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")
    new = spark.createDataFrame([("b", [3.0], 1), ("c", [4.0], 2)], "id string, vector array<double>, o int").drop("o")
    writers.merged_points(old, new, "id", ["id"], str(tmp_path / "p"))
    assert {r["id"]: r["vector"] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    assert "ReadSchema: struct<id:string>" in readers.payloads(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()


def test_evaluation_builder_and_sink(spark, tmp_path):
    rows = [(1, "5/2010", "Điều 1", "Tên", "Luật A", "nội  dung"), (2, "5/2010", "Điều 1", "khác", None, "x"), (3, None, "Điều 2", None, None, "y"),
            (4, "6/2010", "Điều 3", None, None, "z" * 200)]
    df = spark.createDataFrame(rows, "o int, doc_number string, dieu string, dieu_title string, doc_name string, content string")
    built, counters = evaluation_set.build(df, ["o"], style="title")
    got = {r["corpus_id"]: r["query_text"] for r in built.collect()}
    assert got["5/2010+1"] == "Tên được quy định như thế nào?" and got["6/2010+3"] == "Điều 3 của văn bản 6/2010 quy định gì?"
    assert tuple(counters.first()) == (4, 1, 0, 2)
    article, _ = evaluation_set.build(df, ["o"], style="article")
    assert {r["query_text"] for r in article.collect()} >= {"Điều 1 trong Luật A quy định gì?"}
    mixed, _ = evaluation_set.build(df, ["o"], style="mixed", max_queries=1)
    assert [r["query_id"] for r in mixed.collect()] == ["int_000001"]
    active = spark.createDataFrame([("6/2010+3",)], "corpus_id string")
    _, few = evaluation_set.build(df, ["o"], active=active)
    assert tuple(few.first()) == (4, 1, 2, 1)
    writers.evaluation_set(built, str(tmp_path))
    writers.manifest(counters, str(tmp_path), {"style": "title", "seed": 42})
    queries, qrels = readers.evaluation_set(spark, str(tmp_path))
    assert queries.count() == 2 and qrels.count() == 2
    assert spark.read.json(str(tmp_path / "manifest.json")).first()["queries_generated"] == 2


def test_encoders(spark):
    df = spark.createDataFrame([(1, "quyền tác giả"), (2, "quyền tác giả"), (3, "hoàn toàn khác biệt")], "i int, text string")
    model = encode.fit_hashed(df, "text", 64)
    got = {r["i"]: r["vector"] for r in encode.encode_hashed(df, model).collect()}
    assert len(got[1]) == 64 and got[1] == got[2] != got[3]
    assert abs(sum(x * x for x in got[3]) - 1) < 1e-5

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    own = encode.encode_with(df, "text", make, batch_size=2).orderBy("i").collect()
    assert own[0]["vector"] == [13.0, 1.0]


def test_parameter_checks():
    assert schemas.check_range("top_k", 5, 1, 20) == 5
    with pytest.raises(ValueError):
        schemas.check_range("top_k", 0, 1, 20)


def test_key_uniqueness(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chunks = chunking.marker_chunks(docs, "doc_id", "text")
    assert graph.duplicate_keys(chunks, ["chunk_id"]).count() == 0
    assert graph.duplicate_keys(chunks, ["doc_id"]).count() > 0


def test_chunk_ids_tell_late_differences_apart(spark):
    df = spark.createDataFrame([("x" * 300 + "a",), ("x" * 300 + "b",)], "c string")
    ids = lambda parity: {r[0] for r in df.select(corpus_ids.legal_chunk_id(F.lit("d"), F.lit(0), F.col("c"), parity)).collect()}
    assert len(ids(False)) == 2 and len(ids(True)) == 1
