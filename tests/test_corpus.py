"""Corpus tables from stored chunk rows against those that run the chunker for each table."""

from lexgrove.plans import corpus

DECREE = """CHÍNH PHỦ
Nghị định số: {}/2020/NĐ-CP
Hà Nội, ngày 5 tháng 6 năm 2020
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
Một.
Điều 2. Đối tượng
Hai {}."""
JUDGMENT = """TÒA ÁN NHÂN DÂN TỈNH A
Bản án số: {}/2020/DS-ST
NỘI DUNG VỤ ÁN:
Nguyên đơn A trình bày: một
NHẬN ĐỊNH CỦA TÒA ÁN:
[1] hai
[2] ba
Vì các lẽ trên,
QUYẾT ĐỊNH:
1. bốn
2. năm"""


def same(a, b):
    assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(a.columns)).collect()))


def test_stored_tables_equal_derived_ones(spark, tmp_path):
    laws = [(f"{i}.txt", DECREE.format(i, i)) for i in range(5)] + [("9-copy.txt", DECREE.format(3, 3)), ("empty.txt", "")]
    docs = spark.createDataFrame(laws, "filename string, text string").repartition(3)
    plain, stored = corpus.legal_corpus(docs), corpus.stored_legal_corpus(docs, str(tmp_path / "legal"))
    same(plain.documents, stored.documents)
    same(plain.chunks, stored.chunks)
    same(plain.next_edges, stored.next_edges)
    per_law = stored.rows_kept // 5
    assert stored.rows_read == 6 * per_law and stored.rows_kept == 5 * per_law  # the copy breaks the key

    cases = [(f"{i}.txt", JUDGMENT.format(i)) for i in range(4)] + [("x.txt", JUDGMENT.format(1)), ("none.txt", None)]
    docs = spark.createDataFrame(cases, "filename string, text string").repartition(3)
    plain, stored = corpus.verdict_corpus(docs), corpus.stored_verdict_corpus(docs, str(tmp_path / "verdict"))
    for name in ("documents", "chunks", "next_edges", "typed_edges"):
        same(getattr(plain, name), getattr(stored, name))
    assert stored.rows_read > stored.rows_kept
