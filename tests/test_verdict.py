from pyspark.sql import functions as F

from lexgrove.functions import verdict
from lexgrove.operators import chunking as ch
from lexgrove.plans.corpus import verdict_corpus

TEXT = """TÒA ÁN NHÂN DÂN  THÀNH PHỐ HÀ NỘI
Bản án số: 12/2020/KDTM-PT
Ngày 5 tháng 3 năm 2020
V/v: "Tranh chấp quyền sở hữu trí tuệ."
Chủ tọa phiên tòa: Ông Trần A
Các Thẩm phán: Ông Lê B
Bà Phạm C.
- Nguyên đơn: Công ty A;
- Bị đơn: Công ty B;
NỘI DUNG VỤ ÁN:
Mở đầu ngắn.
Nguyên đơn Công ty A trình bày: nhãn hiệu của tôi.
Bị đơn Công ty B trình bày: không đồng ý.
Tại Bản án kinh doanh sơ thẩm đã quyết định.
NHẬN ĐỊNH CỦA TÒA ÁN:
[1] Về tố tụng. Căn cứ Điều 30 Bộ luật tố tụng dân sự năm 2015, tòa.
[2.1] Về nội dung. QUYẾT ĐỊNH: sai chỗ.
Vì các lẽ trên,
QUYẾT ĐỊNH:
Căn cứ vào các điều luật nêu trên đây và các quy định
1. Chấp nhận yêu cầu.
2. Án phí: bị đơn chịu.
"""


def one(spark, column, text=TEXT, filename="BA 12 - 2020.txt"):
    df = spark.createDataFrame([(text, filename)], "text string, filename string")
    return df.select(column.alias("x")).first()["x"]


def items(spark, make, text, parity=False):
    return [tuple(x) for x in one(spark, make(F.col("text"), parity), text)]


def test_metadata(spark):
    c, f = F.col("text"), F.col("filename")
    meta = {k: one(spark, v) for k, v in verdict.metadata(c, f).items()}
    assert meta == {
        "case_number": "12/2020/KDTM-PT",
        "court_name": "TÒA ÁN NHÂN DÂN THÀNH PHỐ HÀ NỘI",
        "judgment_date": "2020-03-05",
        "dispute_type": "Tranh chấp quyền sở hữu trí tuệ",
        "trial_level": "phúc thẩm",
        "plaintiff": "Công ty A",
        "defendant": "Công ty B",
        "third_party": "",
        "ip_types": ["nhãn hiệu"],
        "judges": "Ông Trần A; Lê B; Phạm C",
        "law_references": ["Điều 30 Bộ luật tố tụng dân sự năm 2015"],
    }
    assert one(spark, verdict.case_number(c, f), "x") == "12/2020"
    assert one(spark, verdict.case_number(c, f), "x", "khac.txt") == "khac.txt"
    assert one(spark, verdict.right_types(c), "x") == ["sở hữu trí tuệ"]
    assert one(spark, verdict.trial_level(c, F.lit("1/2020/KDTM-ST"))) == "sơ thẩm"
    assert one(spark, verdict.trial_level(c, F.lit("1/2020")), "SƠ THẨM") == "sơ thẩm"
    assert one(spark, verdict.judgment_date(c), "Ngày: 7-8-2019") == "2019-08-07"
    assert one(spark, verdict.judgment_date(c), "x") == ""


def test_ocr_repair(spark):
    fixed = one(spark, verdict.repair_ocr(F.col("text")), "12  Tòa\n[ 3] a\n[4   Bị\n a    b\n\n\n\n\nc")
    assert fixed == "[12] Tòa\n[3] a\n[4] Bị\n a  b\n\n\nc"


def test_macro_sections(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "chỉ có chữ"), (3, "a\nQUYẾT ĐỊNH: b\n  QUYẾT ĐỊNH : c")], "i int, text string")
    rows = {r["i"]: r for r in ch.macro_sections(df).collect()}
    assert rows[1]["header"].startswith("TÒA ÁN") and rows[1]["header"].endswith("Công ty B;")
    assert rows[1]["facts"].startswith("Mở đầu ngắn.")
    assert rows[1]["reasoning"].endswith("Vì các lẽ trên,")
    assert rows[1]["decision"].startswith("Căn cứ vào")
    assert (rows[2]["header"], rows[2]["facts"], rows[2]["reasoning"], rows[2]["decision"]) == ("", "", "chỉ có chữ", "")
    assert (rows[3]["reasoning"], rows[3]["decision"]) == ("a\nQUYẾT ĐỊNH: b", "c")


def test_fact_items(spark):
    text = "Mở đầu. Nguyên đơn A trình bày: x. Bị đơn B trình bày: y."
    assert items(spark, ch.fact_items, text) == [
        ("Mở đầu.", "nội dung"), ("Nguyên đơn A trình bày: x.", "nguyên đơn"), ("Bị đơn B trình bày: y.", "bị đơn"),
    ]
    assert items(spark, ch.fact_items, text, True)[0][1] == "nguyên đơn"
    assert items(spark, ch.fact_items, "không chia") == [("không chia", "nội dung")]
    assert items(spark, ch.fact_items, " ") == []
    both = "Đại diện Viện kiểm sát phát biểu ý kiến: z"
    assert [label for _, label in items(spark, ch.fact_items, both)][-1] == "viện kiểm sát"


def test_point_items(spark):
    text = "ngắn\n[1] một\n[2.1] hai"
    assert items(spark, ch.point_items, text) == [("ngắn", "intro"), ("[1] một", "[1]"), ("[2.1] hai", "[2.1]")]
    assert items(spark, ch.point_items, text, True) == [("[1] một", "[1]"), ("[2.1] hai", "[2.1]")]
    assert items(spark, ch.point_items, "không") == [("không", "")]


def test_decision_styles(spark):
    intro = "Căn cứ các điều luật sau đây của bộ luật"
    cases = {
        f"{intro}\n1/. a\n2/. Án phí b": ["căn cứ", "1/.", "án phí 2/."],
        f"{intro}\n[1] a\n[2] b": ["căn cứ", "[1]", "[2]"],
        f"{intro}\nI. a\nII. b\nIII. c": ["căn cứ", "I.", "II.", "III."],
        f"{intro}\n1. a\n2. b": ["căn cứ", "1.", "2."],
    }
    for text, labels in cases.items():
        assert [x[1] for x in items(spark, ch.decision_items, text)] == labels
    fee = "x" * 60 + " Án phí do bị đơn chịu"
    assert items(spark, ch.decision_items, fee) == [("x" * 60, "quyết định"), ("Án phí do bị đơn chịu", "án phí")]
    assert items(spark, ch.decision_items, "ngắn án phí") == [("ngắn án phí", "")]
    # an empty numeral counts as a roman item in parity mode only
    odd = "\n. a\n. b\n. c\n1. d\n2. e"
    assert [x[1] for x in items(spark, ch.decision_items, odd, True)] == [".", ".", "."]
    assert [x[1] for x in items(spark, ch.decision_items, odd)][-2:] == ["1.", "2."]


def test_oversize_labels_and_parity(spark):
    long = "Tại Bản án kinh doanh sơ thẩm " + "câu chữ dài. " * 20
    text = TEXT.replace("Tại Bản án kinh doanh sơ thẩm", long)
    df = spark.createDataFrame([("f.txt", text)], "filename string, text string")
    rows = ch.verdict_chunks(df, size=100, overlap=10).orderBy("chunk_index").collect()
    lower = [r for r in rows if r["party_role"].startswith("bản án sơ thẩm")]
    assert [r["party_role"] for r in lower][:3] == ["bản án sơ thẩm", "bản án sơ thẩm-p2", "bản án sơ thẩm-p3"]
    assert {r["section_type"] for r in lower} == {"lower_court_decision"}
    assert max(len(r["content"]) for r in rows) <= 100
    old = ch.verdict_chunks(df, parity=True, size=100, overlap=10).collect()
    assert {r["section_type"] for r in old if r["party_role"].endswith("-p2")} == {"fact"}


def test_corpus_edges(spark):
    df = spark.createDataFrame([("BA 1 - 2020.txt", TEXT), ("BA 2 - 2021.txt", "không rõ")], "filename string, text string")
    corpus = verdict_corpus(df)
    assert corpus.documents.count() == 2
    assert corpus.next_edges.count() == corpus.chunks.count() - 2
    kinds = {r["rel_type"]: r["count"] for r in corpus.typed_edges.groupBy("rel_type").count().collect()}
    assert kinds == {"CÓ_TÌNH_TIẾT": 4, "CÓ_NHẬN_ĐỊNH": 3, "ĐÃ_TUYÊN_ÁN": 3}
    summary = corpus.documents.where("filename like '%2020%'").first()["summary"]
    assert summary == (
        "Bản án số 12/2020/KDTM-PT, Tranh chấp quyền sở hữu trí tuệ, giữa Công ty A và Công ty B, "
        "cấp phúc thẩm, tại TÒA ÁN NHÂN DÂN THÀNH PHỐ HÀ NỘI"
    )


def test_a_text_is_folded_once(spark):
    from lexgrove.functions import legal

    docs = spark.createDataFrame([(None,), ("",), ("NHÃN HIỆU và Sáng Chế",), ("abc",)], "t string")
    types = docs.select(verdict.right_types(F.col("t")).alias("x"), legal.document_type(F.lit("a"), F.col("t")).alias("d"))
    plan = types._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t") == 1 and plan.count("lower(substring") <= 1
    default = ["sở hữu trí tuệ"]
    assert [r["x"] for r in types.collect()][1:] == [default, ["nhãn hiệu", "sáng chế"], default]
    refs = docs.select(verdict.law_references(F.col("t"))).collect()
    assert [r[0] for r in refs] == [None, [], [], []]
    one = spark.createDataFrame([("theo ĐIỀU 5 Luật Sở hữu trí tuệ",)], "t string")
    assert one.select(verdict.law_references(F.col("t"))).first()[0] == ["ĐIỀU 5 Luật Sở hữu trí tuệ"]
