from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.operators import assemble as asm


def test_history_and_titles(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)]
    rows += [(2, 0, "assistant", "x" * 501), (2, 1, "user", "y" * 31), (2, 2, "user", "later")]
    df = spark.createDataFrame(rows, "s int, t int, role string, text string")
    got = {r["s"]: r["history"] for r in asm.histories(df, "s", "t", "role", "text").collect()}
    head = "\nLỊCH SỬ HỘI THOẠI (tham khảo để hiểu ngữ cảnh):\n"
    assert got[1] == head + "User: m2\nAssistant: m3\nUser: m4\nAssistant: m5\nUser: m6\n"
    assert got[2] == head + "Assistant: " + "x" * 500 + "...\nUser: " + "y" * 31 + "\nUser: later\n"
    more = df.unionByName(spark.createDataFrame([(3, 0, "assistant", "a")], df.schema))
    titles = {r["s"]: r["title"] for r in asm.session_titles(more, "s", "t", "role", "text").collect()}
    assert titles == {1: "m0", 2: "y" * 30 + "...", 3: fv.DEFAULT_SESSION_TITLE}


def test_legal_context_and_prompt(spark):
    hits = spark.createDataFrame(
        [(1, 2, "N2", None, "", "Điều 1", "T", None, "c2", None, "a\n---\n"), (1, 1, None, "5", "Luật", None, None, "2010-01-01", "c1", "b\n---\n", None)],
        "query_id int, rank int, doc_name string, doc_number string, doc_type string, dieu string, dieu_title string, "
        "effective_date string, content string, context_before string, context_after string",
    )
    context = asm.contexts(hits, asm.legal_block())
    text = context.first()["context"]
    assert text == (
        "\n=== NGUỒN 1 ===\n📄 N/A | Số: 5 | Loại: Luật\n📍 N/A - \n📅 Hiệu lực: 2010-01-01\n\n"
        "[Context trước]\nb\n---\n\nc1\n\n\n=== NGUỒN 2 ===\n📄 N2 | Số: N/A | Loại: N/A\n📍 Điều 1 - T\n"
        "📅 Hiệu lực: N/A\n\nc2\n[Context sau]\na\n---\n\n"
    )
    queries = spark.createDataFrame([(1, "hỏi"), (2, "khác")], "query_id int, text string")
    past = spark.createDataFrame([(1, "H")], "query_id int, history string")
    got = {r["query_id"]: r["prompt"] for r in asm.prompts(queries, context, fv.STATUTE_PROMPT, fv.NO_STATUTE, past).collect()}
    assert got[1].startswith("H\n\nCÂU HỎI: hỏi\n\nVĂN BẢN PHÁP LUẬT:\n" + text) and got[2] == fv.NO_STATUTE


def test_verdict_context_and_cases(spark):
    hits = spark.createDataFrame(
        [(1, 1, "C1", "reasoning", "[2]", "", "", ["a", "b"], "x"), (1, 2, "C2", "fact", "", "nguyên đơn", "", [], "y"),
         (1, 3, "C1", "decision_item", "", "", "1.", [], "z"), (1, 4, "", "other", "", "", "", [], "w")],
        "query_id int, rank int, case_number string, section_type string, point_number string, party_role string, "
        "item_number string, ip_types array<string>, content string",
    ).withColumns({c: F.lit("") for c in ("court_name", "judgment_date", "trial_level", "plaintiff", "defendant")})
    hits = hits.withColumns({c: F.lit(None).cast("string") for c in ("context_before", "context_after")})
    context = asm.contexts(hits, asm.verdict_block())
    text = context.first()["context"]
    for part in ("Phần: Nhận định pháp lý | Luận điểm [2]\n\nx", "Phần: Tình tiết vụ án | nguyên đơn\n", "Phần: Phán quyết | Khoản 1.\n",
                 "Phần: other\n", "Loại sở hữu trí tuệ: a, b\n", "Số: N/A | Tòa: N/A"):
        assert part in text
    cases = asm.case_lists(hits)
    assert cases.first()["case_list"] == "C1, C2"
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, text string")
    got = {r["query_id"]: r["prompt"] for r in asm.prompts(queries, context, fv.VERDICT_PROMPT, fv.NO_VERDICT, None, cases).collect()}
    assert "được phép trích dẫn: C1, C2)" in got[1] and got[2] == fv.NO_VERDICT
    both = asm.combined_contexts(context.withColumn("context", F.lit("L")), context.withColumn("context", F.lit("V")), cases)
    assert both.first()["context"] == (
        "[VĂN BẢN PHÁP LUẬT]:\nL\n[BẢN ÁN THAM KHẢO] (CHỈ các bản án sau được phép trích dẫn: C1, C2):\nV"
    )
    ready = asm.prompts(queries, both, fv.COMBINED_PROMPT, fv.NO_COMBINED).where("query_id = 1").first()["prompt"]
    assert ready.startswith("\n\nCÂU HỎI: q\n\n[VĂN BẢN PHÁP LUẬT]:\nL")


def test_trademark_block(spark):
    columns = ["owner_name", "owner_country", "registration_number", "application_number", "st13", "ipr_type", "feature",
               "country_of_filing", "ip_office", "status", "application_date", "registration_date", "expiry_date"]
    hits = spark.createDataFrame(
        [(1, 1, "ABC", ["25"], 0.125, "fuzzy")], "query_id int, rank int, name string, classes array<string>, score double, match_type string"
    ).withColumns({c: F.lit(None).cast("string") for c in columns}).withColumns({"owner_name": F.lit("O"), "ip_office": F.lit("VN"), "st13": F.lit("S")})
    context = asm.contexts(hits, asm.trademark_block(), "\n\n")
    assert context.first()["context"] == (
        "[1] Nhãn hiệu: ABC\n    Chủ sở hữu: O ()\n    Số đăng ký: \n    ST13: S\n    Nhóm Nice: 25\n    Loại: N/A\n"
        "    Nước đăng ký: VN\n    Trạng thái: \n    Mức giống: 12% (fuzzy)"
    )
    queries = spark.createDataFrame([(1, "abc"), (2, "zz")], "query_id int, text string")
    got = {r["query_id"]: r["prompt"] for r in asm.trademark_prompts(queries, context).collect()}
    assert fv.NO_TRADEMARK in got[2] and 'nhãn hiệu "zz"' in got[2] and "[1] Nhãn hiệu: ABC" in got[1]
