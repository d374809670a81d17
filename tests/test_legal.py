from pyspark.sql import functions as F

from lexgrove.functions import legal
from lexgrove.functions.text import title_case
from lexgrove.operators.chunking import statute_chunks
from lexgrove.plans.corpus import legal_corpus

LAW = """QUỐC HỘI
Luật số: 50/2005/QH11
Hà Nội, ngày 29 tháng 11 năm 2005
- 3 -
Trang 12
Formatted: Font
LUẬT
SỞ HỮU TRÍ TUỆ
Chương I
NHỮNG QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Luật này quy định về quyền tác giả, quyền liên quan đến quyền tác giả.
Mục 2
Điều 2a. Đối tượng
Luật này có hiệu lực thi hành kể từ ngày 1 tháng 7 năm 2006.
"""


def one(spark, column, text="", filename=""):
    df = spark.createDataFrame([(text, filename)], "text string, filename string")
    return df.select(column.alias("x")).first()["x"]


def test_page_lines_are_dropped(spark):
    text = one(spark, legal.clean_document(F.col("text")), LAW)
    assert "Trang" not in text and "- 3 -" not in text and "Formatted" not in text
    assert text.startswith("QUỐC HỘI") and text.endswith("2006.")


def test_document_type_order(spark):
    t = lambda f, x="": one(spark, legal.document_type(F.col("filename"), F.col("text")), x, f)
    assert t("1.Thong+tu+lien+tich.txt") == "Thông tư liên tịch"
    assert t("Thong+tu+05.txt") == "Thông tư"
    assert t("99-ND-CP.txt") == "Nghị định"
    assert t("bo+luat+dan+su.txt") == "Bộ luật"
    assert t("x.txt", "NGHỊ ĐỊNH số 1 theo Luật") == "Nghị định"
    assert t("x.txt", "BỘ LUẬT") == "Bộ luật"
    assert t("x.txt", "") == "Văn bản pháp luật"


def test_number_dates_agency_name(spark):
    c = F.col("text")
    assert one(spark, legal.document_number(c), LAW) == "50/2005/QH11"
    assert one(spark, legal.document_number(c), "Nghị định số: 99/2013/NĐ-CP ngày") == "99/2013/NĐ-CP"
    assert one(spark, legal.document_number(c), "không") == ""
    assert one(spark, legal.signing_date(c), LAW) == "2005-11-29"
    assert one(spark, legal.signing_date(c), "ký 3/4/2010") == "2010-04-03"
    assert one(spark, legal.issuing_agency(c), LAW) == "Quốc hội"
    assert one(spark, legal.issuing_agency(c), "bộ văn hoá abc") == "Bộ Văn hóa, Thể thao và Du lịch"
    assert one(spark, legal.issuing_agency(c), "BỘ Y TẾ") == "Bộ Y Tế"
    assert one(spark, legal.issuing_agency(c), "không rõ") is None
    name = legal.document_name(c, F.col("filename"))
    assert one(spark, name, "LUẬT\nSỞ HỮU TRÍ TUỆ.") == "Luật Sở Hữu Trí Tuệ"
    assert one(spark, title_case(c), "SỞ-HỮU\ntrí tuệ") == "Sở-Hữu\nTrí Tuệ"
    assert one(spark, name, "x", "1.2. Lu%E1%BA%ADt+m%E1%BB%9Bi.TXT") == "Luật mới"
    assert one(spark, name, "x", "a%ZZ+b.txt") == "a%ZZ b"


def test_effective_date_forms(spark):
    d = legal.effective_date(F.col("text"), F.col("filename"))
    assert one(spark, d, "có hiệu lực kể từ ngày 2 tháng 3 năm 2010", "2009-01-01") == "2010-03-02"
    assert one(spark, d, "Có hiệu lực thi hành kể từ ngày ký", "2009-01-01") == "2009-01-01"
    assert one(spark, d, "có hiệu lực sau 45 ngày", "2009-01-31") == "2009-03-17"
    assert one(spark, d, "có hiệu lực sau 45 ngày", "2009-45-31") is None
    assert one(spark, d, "có hiệu lực\nsau 45 ngày", "2009-01-31") is None
    assert one(spark, d, "không", "2009-01-01") is None


def test_article_patterns(spark):
    a = lambda x: one(spark, legal.own_article(F.col("text")), x)
    assert tuple(a("Điều 5a. Tên gọi\nx")) == ("Điều 5a", "Tên gọi")
    assert tuple(a("Điều 5. A")) == ("Điều 5", None)
    assert tuple(a("3. Điều 7 được sửa đổi như sau")) == ("Điều 7", "sửa đổi, bổ sung")
    assert tuple(a('"Điều 9. Quyền lợi" x')) == ("Điều 9", "Quyền lợi")
    assert tuple(a("theo Điều 8 của Luật")) == ("Điều 8", None)
    assert a("không có") is None


def test_statute_chunks_carry(spark):
    text = "\n".join(
        ["QUỐC HỘI " + "mở đầu " * 9, "Chương I\nQUY ĐỊNH, CHUNG\nx"]
        + [f"Điều {i}. Nội dung {i}\n" + "câu chữ " * 14 for i in (1, 2)]
        + ["CHƯƠNG II\nPHẦN KHÁC\nkhông số " + "từ " * 10]
    )
    df = spark.createDataFrame([("x.txt", text), ("blank.txt", " \n 12 \n")], "filename string, text string")
    rows = statute_chunks(df, size=80, overlap=0).orderBy("chunk_index").collect()
    assert {r["filename"] for r in rows} == {"x.txt"}
    assert rows[0]["chunk_type"] == "header" and rows[0]["dieu"] is None
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    continued = [r for r in rows if r["is_continuation"]]
    assert continued and all(r["dieu_title"] == f"(tiếp theo {r['dieu']})" for r in continued)
    last = rows[-1]
    assert last["chuong"] == "CHƯƠNG II" and last["dieu"] is None or last["is_continuation"]
    by_article = {r["dieu"]: r["chuong"] for r in rows if r["dieu"] and not r["is_continuation"]}
    assert by_article["Điều 1"] == "Chương I"


def test_corpus_tables(spark):
    df = spark.createDataFrame([("a.txt", LAW), ("b.txt", LAW), ("c.txt", "khác hẳn")], "filename string, text string")
    corpus = legal_corpus(df)
    docs = {r["doc_id"]: r["filename"] for r in corpus.documents.collect()}
    assert docs == {"50/2005/QH11": "b.txt", "c.txt": "c.txt"}
    chunks, edges = corpus.chunks.count(), corpus.next_edges.count()
    assert edges == chunks - corpus.documents.count()
    assert corpus.documents.where("doc_id = 'c.txt'").first()["issuing_agency"] is None
