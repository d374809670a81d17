import random

from pyspark.sql import functions as F

from lexgrove.operators import retrieval as rt


def verdict_tables(spark):
    verdicts = spark.createDataFrame(
        [("C1", "C1", ["nhãn hiệu"], "sơ thẩm"), ("C2", "C2", ["sáng chế"], "phúc thẩm")],
        "verdict_id string, case_number string, ip_types array<string>, trial_level string",
    ).withColumns({c: F.lit("") for c in rt.VERDICT_DOC_FIELDS if c not in ("case_number", "ip_types", "trial_level")})
    rows = []
    for case in ("C1", "C2"):
        for i, section in enumerate(["header", "fact", "reasoning", "reasoning", "decision_item"]):
            rows.append((f"{case}-{i}", case, f"text {case} {i}", i, i, section))
    chunks = spark.createDataFrame(
        rows, "vchunk_id string, verdict_id string, content string, chunk_index int, position int, section_type string"
    ).withColumns({c: F.lit("") for c in ("point_number", "party_role", "item_number")})
    vec = spark.createDataFrame(
        [("C1-0", [1.0, 0.0]), ("C1-1", [0.9, 0.1]), ("C1-2", [0.8, 0.3]), ("C1-3", [0.1, 1.0]), ("C1-4", [0.0, 1.0]),
         ("C2-1", [0.7, 0.7]), ("C2-4", [-1.0, 0.0]), ("gone", [1.0, 0.01])],
        "id string, vector array<double>",
    )
    return verdicts, chunks, vec


def test_verdict_search_boosts_and_completes(spark):
    verdicts, chunks, vec = verdict_tables(spark)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    hits = rt.verdict_search(queries, vec, chunks, verdicts, k=2).orderBy("rank").collect()
    # fetched: C1-0 1.0, gone, C1-1 .9939, C1-2 .9363 -> boosted reasoning first
    assert [h["vchunk_id"] for h in hits] == ["C1-2", "C1-0", "C1-4"]
    assert hits[0]["score"] > 1.2 and hits[2]["score"] == 0.5
    assert hits[0]["context_before"] == "text C1 1\n---\n" and hits[2]["context_after"] is None
    plain = rt.verdict_search(queries, vec, chunks, verdicts, k=2, boost=False).orderBy("rank").collect()
    assert [h["vchunk_id"] for h in plain] == ["C1-0", "C1-2", "C1-3", "C1-4"]
    only = rt.verdict_search(queries, vec, chunks, verdicts, k=1, ip_types=["sáng chế"]).collect()
    assert {h["case_number"] for h in only} == {"C2"}
    off = rt.verdict_search(queries, vec, chunks, verdicts, k=1, ip_types=["sáng chế"], prefilter=False)
    assert {h["case_number"] for h in off.collect()} == {"C1"}
    level = rt.matching_verdicts(verdicts, None, "phúc thẩm")
    assert [r["verdict_id"] for r in level.collect()] == ["C2"]
    sources = rt.verdict_sources(rt.verdict_search(queries, vec, chunks, verdicts, k=2))
    assert sources.columns[:3] == ["query_id", "rank", "case_number"]


def legal_tables(spark):
    documents = spark.createDataFrame(
        [("D1", "Luật", "active", "2010-01-01"), ("D2", "Luật", "active", "2030-01-01"),
         ("D3", "Nghị định", "active", None), ("D4", "Luật", "expired", None)],
        "doc_id string, doc_type string, status string, effective_date string",
    ).withColumns({"doc_name": F.col("doc_id"), "doc_number": F.col("doc_id")})
    chunks = spark.createDataFrame(
        [(f"{d}-{i}", d, f"{d} {i}", i, i) for d in ("D1", "D2", "D3", "D4") for i in range(3)],
        "chunk_id string, doc_id string, content string, chunk_index int, position int",
    ).withColumns({c: F.lit(None).cast("string") for c in ("dieu", "dieu_title", "chuong")})
    vec = chunks.select(
        F.col("chunk_id").alias("id"), F.array(F.lit(1.0), (F.col("position") * 0.1 + F.substring("doc_id", 2, 1).cast("double"))).alias("vector")
    )
    return documents, chunks, vec


def test_legal_search_filters(spark):
    documents, chunks, vec = legal_tables(spark)
    queries = spark.createDataFrame([(7, [1.0, 9.0])], "query_id int, vector array<double>")
    found = rt.legal_search(queries, vec, chunks, documents, k=4, day="2020-01-01")
    assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == ["D3-2", "D3-1", "D3-0", "D1-2"]
    law = rt.legal_search(queries, vec, chunks, documents, k=1, day="2020-01-01", doc_types=["Luật"]).first()
    assert law["chunk_id"] == "D1-2" and law["context_before"] == "D1 1\n---\n" and law["context_after"] is None
    every = rt.legal_search(queries, vec, chunks, documents, k=1, prefilter=False).first()
    assert every["chunk_id"] == "D4-2"
    ids = rt.legal_search(queries, vec, chunks, documents, k=2, day="2020-01-01", ids_only=True)
    assert ids.columns == ["query_id", "rank", "id", "score"]
    none = rt.legal_search(queries, vec, chunks, documents, k=2, day="2020-01-01", doc_types=["?"])
    assert none.count() == 0
    both = rt.combined_search(found, found)
    assert both.groupBy("source").count().count() == 2
    assert rt.legal_sources(found).count() == 4


def test_hits_per_query(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, id string")
    assert {tuple(r) for r in rt.hits_per_query(queries, hits).collect()} == {(1, 2), (2, 0)}


def test_related_documents(spark):
    docs = spark.createDataFrame(
        [("A", "B", None), ("B", None, ["A", "Z"]), ("C", "X", ["A", "A"])],
        "doc_number string, amends string, amended_by array<string>",
    )
    got = {tuple(r) for r in rt.related_documents(docs).select("doc_number", "related_number", "relation").collect()}
    assert got == {("A", "B", "amends"), ("A", "B", "amended_by"), ("A", "C", "amended_by")}


def test_lookup_and_completion_order(spark):
    verdicts, chunks, _ = verdict_tables(spark)
    assert [r["chunk_index"] for r in rt.lookup(chunks, "verdict_id", "C2", "chunk_index").collect()] == list(range(5))
    details = chunks.withColumn("case_number", F.col("verdict_id"))
    hits = details.where("vchunk_id in ('C2-0', 'C1-4')").withColumn("query_id", F.lit(1))
    extra = rt.complete_sections(hits, details, "case_number", "section_type", "vchunk_id", max_hits=2)
    assert [r["vchunk_id"] for r in extra.orderBy("extra_rank").collect()] == ["C1-2", "C1-3", "C2-2", "C2-3", "C2-4"]


def test_completion_equals_sorting_each_query(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(90)}", rng.choice(["A", "B", "C"]), rng.choice(["r", "d", "f"]), i) for i in range(120)]
    chunks = spark.createDataFrame(rows, "id string, case string, section string, place int")
    asked = [(q, *rng.choice(rows)) for q in range(8) for _ in range(rng.randint(1, 3))]
    asked += [(9, "k0", None, "r", 0), (9, "k1", "", "d", 0)]
    hits = spark.createDataFrame(asked, "query_id int, id string, case string, section string, place int")
    got = rt.complete_sections(hits, chunks, "case", "section", "id", ("r", "d"), "place")
    want = set()
    for q in {a[0] for a in asked}:
        own = [a for a in asked if a[0] == q and a[2]]
        present, ids = {(a[2], a[3]) for a in own}, {a[1] for a in asked if a[0] == q}
        lacking = {(a[2], s) for a in own for s in ("r", "d")} - present
        added = sorted((c, p, i) for i, c, s, p in rows if (c, s) in lacking and i not in ids)
        want |= {(q, i, p, n) for n, (c, p, i) in enumerate(added, 1)}
    assert want and {(r["query_id"], r["id"], r["place"], r["extra_rank"]) for r in got.collect()} == want
    assert dict(got.dtypes)["extra_rank"] == "int"


def test_texts_are_derived_once_per_chunk(spark):
    verdicts, chunks, vec = verdict_tables(spark)
    chunks = chunks.withColumn("content", F.when(F.col("vchunk_id") != "C1-1", F.col("content")))
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "query_id int, vector array<double>")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(text):
        calls.add(1)
        return text and len(text)

    derive = lambda rows: rows.withColumn("n", length("content")).drop("content")
    found = rt.verdict_search(queries, vec, chunks, verdicts, k=1, derive=derive).collect()
    assert len(found) == 80 and {r["n"] for r in found} == {9}
    assert {r["context_before"] for r in found} == {None, "", "text C1 2\n---\n", "text C1 3\n---\n"}
    assert calls.value < 80  # the completing chunks are the same for all queries


def test_native_expressions_are_derived_once_per_chunk(spark):
    """A broadcast join evaluates what is below it once a match, unless an exchange lies between."""
    verdicts, chunks, vec = verdict_tables(spark)
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "query_id int, vector array<double>")
    derive = lambda rows: rows.withColumn("digest", F.md5("content")).drop("content")
    found = rt.verdict_search(queries, vec, chunks, verdicts, k=1, derive=derive)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    places = [i for i, line in enumerate(plan) if "md5(" in line]
    completing = plan[places[-1] - 1]
    assert len(places) == 2 and "Exchange hashpartitioning(vchunk_id" in completing
    assert len({r["digest"] for r in found.collect()}) == 4
