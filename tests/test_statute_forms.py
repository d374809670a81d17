"""Every branch of the statute chunker occurs in the registered query over written-out statutes."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from lexgrove.operators import lines


def test_every_branch_occurs(spark, data):
    rows = entry.queries()["statute_forms"](spark, data).cache()
    seen = lambda c: {r[0] for r in rows.select(c).distinct().collect()}
    assert seen("chunk_type") == {"header", "content", "appendix", "signature"}
    assert seen("doc_type") == {"Luật", "Thông tư liên tịch", "Thông tư", "Bộ luật", "Quyết định", "Nghị định", "Văn bản pháp luật"}
    assert seen("issuing_agency") == {"Quốc hội", "Bộ Tài chính", "Bộ Y Tế", "Bộ Văn hóa, Thể thao và Du lịch", "Chính phủ", None}
    assert seen("signing_date") == {"2005-11-29", "2011-04-03", "2012-08-07", "2016-10-09", "2013-02-01", None}
    assert seen("effective_date") == {"2006-07-01", "2011-05-18", "2012-08-07", None}
    assert {"Luật Sở Hữu Trí Tuệ", "Luật Dân Sự"} < seen("doc_name") and "" in seen("doc_number")
    chapters = seen("chuong")
    assert {"Chương IV", "CHƯƠNG XI", "Chương 6"} < chapters
    titles = seen("dieu_title")
    assert {"sửa đổi, bổ sung", "Tên"} < titles and any(t and t.startswith("(tiếp theo") for t in titles) and None in titles
    assert any(p for p in seen("phan")) and any(m for m in seen("muc"))


def test_records_inside_rows_are_those_of_lines(spark, data):
    pages = spark.createDataFrame(
        [(1, "x\n\nA\nOwner\no (VN)\nNice class\n1, b\n2\nOwner\nOwner\nNumber\n7\nFilters\nOwner\nq"), (2, None), (3, ""), (4, "Owner"),
         (5, "n\nOwner"), (6, "\n".join(f"m{i}\nOwner\nw{i}\nNice class\n{i}" for i in range(3000)))],
        "page int, text string",
    )
    rows = lines.trademark_pages(pages, "page", F.col("text"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    old = lines.trademark_cards(lines.lines_of(pages, "page", F.col("text")), "page").select(*rows.columns)
    assert rows.exceptAll(old).count() == 0 and old.exceptAll(rows).count() == 0
    assert rows.where("page = 6").count() == 3000
