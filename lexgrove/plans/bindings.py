"""The operators bound to the given tables: one function per registered query.

Every function reads whole tables of a folder of Parquet files and returns a
lazy DataFrame. Documents stand in for statute and verdict texts, conversations
for chunk sequences and messages, orders for dated documents, parts for a name
register, customers for a register that is merged into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove import session
from lexgrove.functions import fixed_values as fv
from lexgrove.functions import legal, text as tx
from lexgrove.functions.corpus_ids import corpus_id, legal_chunk_id
from lexgrove.operators import (
    assemble,
    chunking,
    encode,
    graph,
    inverted_file,
    lines,
    merge,
    metrics,
    names,
    profile,
    retrieval,
    routing,
    sampling,
    sequences,
    vectors,
)
from lexgrove.operators.sizes import if_small
from lexgrove.plans import corpus, evaluation_set, sheet_merge
from lexgrove.sources.readers import payloads, sheet_records, spread
from lexgrove.streaming import incremental, log

KNN_K = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


# ----------------------------------------------------------------- text columns
def clean_lines(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", legal.clean_document(F.col("text")).alias("clean_text"))


def doc_metadata(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    body = F.col("text")
    return docs.withColumn("signing_date", legal.signing_date(body)).select(
        "doc_id",
        legal.document_number(body).alias("doc_number"),
        "signing_date",
        legal.effective_date(body, F.col("signing_date")).alias("effective_date"),
        tx.snippet(body, fv.SNIPPET_CHARS).alias("snippet"),
    )


def doc_type_route(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return pages.select(
        "page_id",
        legal.document_type(F.col("url"), F.col("html")).alias("doc_type"),
        legal.issuing_agency(F.col("html")).alias("issuing_agency"),
        tx.first_rule(
            [
                (tx.any_contains(F.lower("url"), ["/fr/"]), F.lit("French")),
                (tx.any_contains(F.lower("url"), ["/de/"]), F.lit("German")),
                (tx.any_contains(F.lower("url"), ["/es/"]), F.lit("Spanish")),
            ],
            F.lit("English"),
        ).alias("site_section"),
    )


# --------------------------------------------------------------------- chunking
def section_chunks(spark, sf):
    return chunking.marker_chunks(table(spark, sf, "documents"), "doc_id", "text", r"\n")


def packed_chunks(spark, sf):
    return chunking.packed_chunks(documents(spark, sf), "doc_id", "text")


def _as_files(spark, sf) -> DataFrame:
    docs = documents(spark, sf)
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(name.alias("filename"), "text")


def statute_chunks(spark, sf):
    return chunking.statute_chunks(_as_files(spark, sf))


def verdict_chunks(spark, sf):
    return chunking.verdict_chunks(_as_files(spark, sf))


def _plain_lines() -> Column:
    """Lines of a document reduced to letters and blanks."""
    bare = F.transform(
        F.split("text", "\n"), lambda line: F.trim(F.regexp_replace(line, r"[^\p{L} ]+", " "))
    )
    return F.filter(bare, lambda line: line != "")


def _decrees(spark, sf) -> DataFrame:
    """Documents written out as decrees: each line an article, a chapter every seventh."""

    def article(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        chapter = F.concat(F.lit("Chương "), number, F.lit("\nTiêu đề "), number, F.lit("\n"))
        return F.concat(
            F.when(i % 7 == 0, chapter).otherwise(""), F.lit("Điều "), number, F.lit(". "), line
        )

    decree = F.concat(
        F.lit("CHÍNH PHỦ\nNghị định số: "),
        F.col("doc_id").cast("string"),
        F.lit("/2020/NĐ-CP\nHà Nội, ngày 5 tháng 6 năm 2020\n"),
        F.array_join(F.transform(_plain_lines(), article), "\n"),
    )
    return documents(spark, sf).select(_file_name(), decree.alias("text"))


def _file_name() -> Column:
    return F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename")


def statute_articles(spark, sf):
    return chunking.statute_chunks(_decrees(spark, sf)).select(
        "chunk_id", "doc_id", "content", "chunk_index", "chunk_type", "chuong", "chuong_title",
        "dieu", "dieu_title", "is_continuation", "doc_type", "issuing_agency", "signing_date",
    )


def _judgments(spark, sf) -> DataFrame:
    """Documents written out as judgments: lines dealt to facts, points and items."""

    def dealt(lines: Column, rest: int, form) -> Column:
        numbered = F.transform(
            lines,
            lambda line, i: F.when(i % 3 == rest, form(line, (i + 1).cast("string"))),
        )
        return F.array_join(F.array_compact(numbered), "\n")

    judgment = tx.let(_plain_lines(), lambda lines: F.concat(
        F.lit("TÒA ÁN NHÂN DÂN TỈNH A\nBản án số: "),
        F.col("doc_id").cast("string"),
        F.lit("/2020/DS-ST\nNgày 3 tháng 4 năm 2020\nV/v: Tranh chấp nhãn hiệu\n- Nguyên đơn: Ông "),
        F.col("source"),
        F.lit("\n- Bị đơn: Bà B;\nNỘI DUNG VỤ ÁN:\n"),
        dealt(lines, 0, lambda line, n: F.concat(F.lit("Nguyên đơn A trình bày: "), line)),
        F.lit("\nNHẬN ĐỊNH CỦA TÒA ÁN:\n"),
        dealt(lines, 1, lambda line, n: F.concat(F.lit("["), n, F.lit("] "), line)),
        F.lit("\nVì các lẽ trên,\nQUYẾT ĐỊNH:\n"),
        dealt(lines, 2, lambda line, n: F.concat(n, F.lit(". "), line)),
    ))
    return documents(spark, sf).select(_file_name(), judgment.alias("text"))


def verdict_items(spark, sf):
    chunks = chunking.verdict_chunks(_judgments(spark, sf), size=1_000_000_000)
    return chunks.select(
        "vchunk_id", "verdict_id", "chunk_index", "content", "section_type", "party_role",
        "point_number", "item_number", "court_name", "judgment_date", "trial_level", "plaintiff",
        "defendant", F.array_join("ip_types", ",").alias("ip_types"), "summary",
    )


def page_records(spark, sf):
    """Block elements of pages as labelled lines; headings name the records."""
    blocks = F.regexp_replace("html", r"<(h1|h2|p|li|title)[ >/]", "\n$1\n")
    pages = table(spark, sf, "pages").select("page_id", blocks.alias("lines"))
    found = lines.records_in_rows(pages, "page_id", F.col("lines"), "h1", ["h2", "p", "li", "title"])
    shown = {lines.NAME: "lead", "h1": "heading", "p": "paragraph", "li": "item"}
    return found.select(
        "page_id", "record", *[F.get(lines.part_values(F.col("parts"), label), 0).alias(name) for label, name in shown.items()]
    )


def trademark_cards(spark, sf):
    """Documents written out as result pages: every line is a mark with an owner, classes, and every other one a status."""

    def card(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        status = F.concat(F.lit("\nStatus\nRegistered (day "), number, F.lit(")\nIPR\nTrademark"))
        return F.concat(
            line, F.lit("\nOwner\n"), line, F.lit(" ("), F.col("source"), F.lit(")\nNice class\n"), number, F.lit(", x "), F.col("doc_id").cast("string"),
            F.lit("\n9"), F.when(i % 2 == 0, status).otherwise(""), F.lit("\nNumber\n"), number, F.lit("\nFilters\n"),
        )

    shown = F.concat(F.lit("Results view\nOwner\n"), F.array_join(F.transform(_plain_lines(), card), "\n"))
    pages = documents(spark, sf).select("doc_id", shown.alias("page"))
    return lines.trademark_pages(pages, "doc_id", F.col("page")).withColumn("nice_classes", F.array_join("nice_classes", ","))


#: Heads of written-out statutes, one for each way in which type, number, title, issuer and dates are told.
STATUTE_HEADS = (
    "QUỐC HỘI\nLuật số: {id}/2005/QH11\nTrang 12\nHà Nội, ngày 29 tháng 11 năm 2005\nLUẬT\nSỞ HỮU TRÍ TUỆ.\n"
    "Luật này có hiệu lực thi hành kể từ ngày 1 tháng 7 năm 2006.",
    "BỘ TÀI CHÍNH\nSố: {id}/2011/TTLT\nHà Nội, ngày 3 tháng 4 năm 2011\nTHÔNG TƯ LIÊN TỊCH\nCó hiệu lực sau 45 ngày.",
    "BỘ Y TẾ.\nsố {id}/2012/TT-BYT\nThông tư ký 7/8/2012\nThông tư này có hiệu lực kể từ ngày ký.",
    "BỘ LUẬT\nDÂN SỰ.\nQUỐC HỘI\n{id}/2015/QH13\nKhông ghi ngày",
    "BỘ VĂN HOÁ\nQuyết định số: {id}/2016/QĐ-BVH\nNgày 9 tháng 10 năm 2016",
    "Văn bản không có tên\n1. Điều 5 được sửa đổi, bổ sung",
    '"Điều 9. Tên"\nNghị định số: {id}/2013/NĐ-CP\nCHÍNH PHỦ\n1/2/2013',
)
#: Openings of the articles and headings before them, dealt to the lines in turn; ``{n}`` is the line's number.
STATUTE_LINES = (
    "PHẦN THỨ {n}\nChương IV\nTÊN CHƯƠNG.\nĐiều {n}. ", "Mục {n}\nĐiều {n}a. ", '"Điều {n}. ', "{n}. Điều {n} được sửa đổi ",
    "CHƯƠNG XI\nPHẠM VI.\nĐiều {n} của ", "Chương {n}\nTiêu đề\nxem Điều {n} ", "Phụ lục {n} ",
)
STATUTE_TAIL = "TM. ỦY BAN\nNơi nhận"


def _statutes_in_forms(spark, sf) -> DataFrame:
    """Documents written out as statutes of all forms, by the number of the document and of the line."""

    def opening(line: Column, i: Column) -> Column:
        start = F.get(F.array(*[F.lit(t) for t in STATUTE_LINES]), i % len(STATUTE_LINES))
        return F.concat(F.replace(start, F.lit("{n}"), (i + 1).cast("string")), line)

    head = F.get(F.array(*[F.lit(t) for t in STATUTE_HEADS]), (F.col("doc_id") % len(STATUTE_HEADS)).cast("int"))
    text = F.concat_ws(
        "\n", F.replace(head, F.lit("{id}"), F.col("doc_id").cast("string")),
        F.array_join(F.transform(_plain_lines(), opening), "\n"), F.lit(STATUTE_TAIL),
    )
    return documents(spark, sf).select(_file_name(), text.alias("text"))


def statute_forms(spark, sf):
    """Metadata, headings and kinds of the chunks of statutes in all forms, cut small so that short documents have several."""
    return chunking.statute_chunks(_statutes_in_forms(spark, sf), size=250, overlap=40)


# -------------------------------------------------------------------- sequences
def carry_forward(spark, sf):
    turns = table(spark, sf, "conversations")
    heads = turns.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.col("text")).alias("system_text"),
        F.when(F.col("role") == "user", F.col("turn")).alias("user_turn"),
    )
    return sequences.carry_forward(
        heads, "conv_id", "turn", {"system_text": "last_system", "user_turn": "last_user_turn"}
    ).select("conv_id", "turn", "last_system", "last_user_turn")


def _turn_chunks(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.withColumn(
        "chunk_id",
        legal_chunk_id(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")),
    )


def next_edges(spark, sf):
    return sequences.next_edges(_turn_chunks(spark, sf), "conv_id", "turn", "chunk_id")


def context_window(spark, sf):
    turns = sequences.with_position(table(spark, sf, "conversations"), "conv_id", "turn")
    hits = turns.select("conv_id", "turn", "position")
    return sequences.context_of(hits, turns, "conv_id", "position", "text", 1).select(
        "conv_id", "turn", "context_before", "context_after"
    )


def context_window_2(spark, sf):
    turns = sequences.with_position(table(spark, sf, "conversations"), "conv_id", "turn")
    hits = turns.where(F.col("role") == "assistant").select("conv_id", "turn", "position")
    return sequences.context_of(hits, turns, "conv_id", "position", "text", 2).select(
        "conv_id", "turn", "context_before", "context_after"
    )


def history_last5(spark, sf):
    return assemble.histories(
        table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", fv.HISTORY_MESSAGES
    )


def session_titles(spark, sf):
    return assemble.session_titles(
        table(spark, sf, "conversations"), "conv_id", "turn", "role", "text"
    )


def typed_edges(spark, sf):
    relations = [("user", "ASKS"), ("assistant", "ANSWERS")]
    return graph.typed_edges(_turn_chunks(spark, sf), "chunk_id", "conv_id", "role", relations)


def doc_dimension(spark, sf):
    """One row per source and language: described by its last document's first section."""
    docs = table(spark, sf, "documents")
    facts = docs.select(
        "doc_id", "lang", F.concat("source", F.lit("/"), "lang").alias("doc_key")
    )
    sections = chunking.marker_chunks(docs, "doc_id", "text", r"\n").select(
        "doc_id", "chunk_index", F.length("content").alias("first_chars")
    )
    return graph.dimension_of(
        sections.join(facts, "doc_id"), "doc_id", "chunk_index", "doc_key", ["lang", "first_chars"]
    )


def duplicate_keys(spark, sf):
    return graph.duplicate_keys(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


# ---------------------------------------------------------------------- filters
def validity_filter(spark, sf):
    """Lines of finished orders in force on a day, of two priorities."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"),
        F.col("o_orderpriority").alias("doc_type"),
    )
    valid = retrieval.valid_at(orders, "1998-06-30", ["1-URGENT", "2-HIGH"], "F")
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_quantity"
    )
    return retrieval.of_documents(items, valid, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("l_quantity").alias("quantity")
    )


def corpus_subset(spark, sf):
    judged = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(judged, "doc_id", "left_semi")


def resume_anti(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return merge.not_yet_done(docs, table(spark, sf, "labels"), "doc_id")


def point_lookup(spark, sf):
    turns = table(spark, sf, "conversations")
    longest = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("conv_id", F.struct("n", "conv_id"))
    )
    return (
        turns.where(F.col("conv_id") == longest.scalar())
        .select("conv_id", "turn", "role", "text", F.lit(1.0).alias("score"))
        .orderBy("turn")
    )


def related_rows(spark, sf):
    """Nations that share a region's first nation as the amended one."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("amends"))
    by = nation.join(first, "n_regionkey").select(
        F.col("n_nationkey").cast("string").alias("doc_number"),
        F.when(F.col("n_nationkey") != F.col("amends"), F.col("amends").cast("string")).alias("amends"),
        F.array(
            (F.col("n_nationkey") + 1).cast("string"), (F.col("n_nationkey") + 2).cast("string")
        ).alias("amended_by"),
    )
    return retrieval.related_documents(by)


# --------------------------------------------------------------------- profiles
def null_profile(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.null_profile(joined, ["lang", "source", "quality", "toxic"]).withColumn(
        "null_pct", F.round("null_pct", 6)
    )


def type_counts(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    return profile.type_counts(docs, ["lang", "source"]).withColumn("pct", F.round("pct", 6))


def store_stats(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    points = table(spark, sf, "embeddings")
    return profile.counts_of(
        {
            "documents": docs,
            "english_documents": (docs, F.col("lang") == "en"),
            "labelled": labels,
            "good": (labels, F.col("quality") == 1),
            "with_vector": (points, F.col("embedding").isNotNull()),
            "turns": table(spark, sf, "conversations"),
        }
    )


def daily_activity(spark, sf):
    events = table(spark, sf, "events")
    first_seen = F.count_distinct(F.when(F.col("event_type") == "view", F.col("user_id")))
    return profile.daily_series(
        events, "ts", {"visits": F.count(F.lit(1)), "viewers": first_seen}
    )


def prefix_plan(spark, sf):
    parts = table(spark, sf, "part")
    return profile.prefix_plan(parts, "p_name", depth=None)


def page_listing(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("username")
    )
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    # the page is cut before the join: only its rows need a user name
    return (
        profile.page(orders, newest, 20, 100)
        .join(users, "o_custkey", "left")
        .withColumn("username", F.coalesce("username", F.lit(fv.UNKNOWN_USER)))
    )


def retention(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.date_sub(F.to_date(F.max("ts")), 10).cast("timestamp")).scalar()
    kept = merge.unexpired(events, "ts", now)
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("kept"), F.min("ts").alias("oldest")
    )


def cascade_delete(spark, sf):
    """Conversations with a system turn are removed with all their turns."""
    turns = table(spark, sf, "conversations")
    sessions = turns.select("conv_id").distinct()
    gone = turns.where(F.col("role") == "system").select("conv_id")
    left, messages = merge.cascade_delete(sessions, turns, gone, "conv_id")
    return left.join(
        messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conv_id", "left"
    )


# ---------------------------------------------------------------------- vectors
def _queries(spark, sf) -> DataFrame:
    """The stated query set of the approximate and of the filtered searches: every row whose id is divisible by 50, asked against all rows."""
    return _all_queries(spark, sf).where(F.col("query_id") % 50 == 0)


def _all_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )


def _points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


def _section_of(spark, sf) -> DataFrame:
    return payloads(table(spark, sf, "embeddings"), "embedding").select(
        F.col("vec_id").alias("id"), F.col("label").alias("section_type")
    )


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def knn_topk(spark, sf):
    return _shown(vectors.cosine_topk(_all_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True))


def knn_filtered(spark, sf):
    """Only vectors of documents labelled good are candidates."""
    good = table(spark, sf, "labels").where(F.col("quality") == 1)
    allowed = _points(spark, sf).join(
        good.select(F.col("doc_id").alias("id")), "id", "left_semi"
    )
    return _shown(vectors.cosine_topk(_all_queries(spark, sf), allowed, KNN_K, skip_self=True))


def boosted_rerank(spark, sf):
    top = vectors.cosine_topk(_all_queries(spark, sf), _points(spark, sf), 2 * KNN_K, skip_self=True)
    hits = top.join(_section_of(spark, sf), "id")
    return _shown(
        retrieval.boosted(hits, KNN_K, boosts=[(1, 1.3), (2, 1.1)]).select(
            "query_id", "rank", "id", "section_type", "score"
        )
    )


def hydrate_hits(spark, sf):
    top = vectors.cosine_topk(_all_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    most = _all_queries(spark, sf).count() * KNN_K
    return _shown(retrieval.hydrate(top, docs, None, "doc_id", "doc_id", most)).select(
        "query_id", "rank", "doc_id", "score", "lang", "source", "n_chars"
    )


def hits_per_query(spark, sf):
    """How many of a query's hits are labelled good, 0 included."""
    queries = _all_queries(spark, sf)
    top = vectors.cosine_topk(queries, _points(spark, sf), KNN_K, skip_self=True)
    good = table(spark, sf, "labels").where(F.col("quality") == 1)
    hits = top.join(good.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return retrieval.hits_per_query(queries, hits)


def retrieval_metrics(spark, sf):
    """Mean precision, recall and reciprocal rank; relevant is the same label."""
    queries = _all_queries(spark, sf)
    top = vectors.cosine_topk(queries, _points(spark, sf), max(fv.EVAL_KS), skip_self=True)
    section = _section_of(spark, sf)
    own = section.select(F.col("id").alias("query_id"), F.col("section_type").alias("wanted"))
    own = own.join(queries.select("query_id"), "query_id", "left_semi")
    judged = (
        metrics.dedupe_ranked(top)
        .join(section, "id")
        .join(own, "query_id")
        .withColumn("relevant", F.col("section_type") == F.col("wanted"))
    )
    per_label = section.groupBy("section_type").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    totals = own.join(per_label.withColumnRenamed("section_type", "wanted"), "wanted").select(
        "query_id", "n_relevant"
    )
    means = metrics.mean_metrics(metrics.per_query_metrics(judged, totals))
    return means.select(
        "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")], "queries"
    )


def complete_sections(spark, sf):
    """The longest turn of a conversation is its hit; the missing roles are added."""
    turns = _turn_chunks(spark, sf)
    hit = merge.first_by(
        turns.select("conv_id", (-F.length("text")).alias("o"), "turn", "role", "chunk_id"),
        ["conv_id"],
        ["o", "turn"],
    ).withColumn("query_id", F.col("conv_id"))
    added = retrieval.complete_sections(
        hit, turns, "conv_id", "role", "chunk_id", ("user", "assistant"), "turn"
    )
    return added.select("query_id", "conv_id", "turn", "role", "chunk_id", "score", "extra_rank")


def prompt_blocks(spark, sf):
    """Question, history-free context of the hit documents, and the cited sources."""
    queries = _all_queries(spark, sf)
    top = vectors.cosine_topk(queries, _points(spark, sf), KNN_K, skip_self=True)
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("doc_name"),
        F.col("lang").alias("doc_type"),
        F.col("doc_id").cast("string").alias("doc_number"),
        F.col("text").alias("content"),
    )
    most = queries.count() * KNN_K
    hits = retrieval.hydrate(top, docs, None, "doc_id", "doc_id", most).withColumns(
        {
            "dieu": F.lit(None).cast("string"),
            "dieu_title": F.lit(None).cast("string"),
            "effective_date": F.lit(None).cast("string"),
            "context_before": F.lit(None).cast("string"),
            "context_after": F.lit(None).cast("string"),
        }
    )
    contexts = assemble.contexts(hits, assemble.legal_block())
    cases = assemble.case_lists(hits, "doc_name")
    asked = queries.select("query_id", F.concat(F.lit("vector "), "query_id").alias("text"))
    ready = assemble.prompts(asked, contexts, fv.STATUTE_PROMPT, fv.NO_STATUTE)
    return ready.join(cases, "query_id", "left").select(
        "query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"), "case_list"
    )


def verdict_blocks(spark, sf):
    """Context blocks of hits read as verdict chunks, with the cases they cite."""
    # a few narrow rows a query, which blocks and case lists read
    top = session.cut_lineage(vectors.cosine_topk(_all_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.when(F.col("lang") != "fr", F.col("source")).otherwise("").alias("case_number"),
        F.col("lang").alias("court_name"),
    )
    sections = F.array(*[F.lit(name) for name, _ in fv.SECTION_LABELS])
    kind = F.coalesce(F.get(sections, F.col("section_type")), F.lit("other"))
    hits = top.join(_section_of(spark, sf), "id").join(docs, "id").withColumns(
        {
            "section_type": kind,
            "point_number": F.when(F.col("rank") % 2 == 0, F.lit("[2]")).otherwise(""),
            "party_role": F.when(F.col("rank") == 3, F.lit("bị đơn")).otherwise(""),
            "item_number": F.when(F.col("rank") > 1, F.lit("1.")).otherwise(""),
            "ip_types": F.array(F.lit("nhãn hiệu"), F.col("court_name")),
            "context_before": F.when(F.col("rank") == 1, F.lit("trước")),
            "context_after": F.when(F.col("rank") == 5, F.lit("sau")),
            **{c: F.lit("") for c in ("judgment_date", "trial_level", "plaintiff", "defendant")},
        }
    )
    blocks = assemble.contexts(hits, assemble.verdict_block())
    return blocks.join(assemble.case_lists(hits), "query_id", "left").select(
        "query_id", F.md5("context").alias("context_md5"), "case_list"
    )


def evaluation_run(spark, sf):
    """Quality of ranking the turns of a conversation by length; answers are relevant."""
    turns = table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
    queries = turns.groupBy("query_id").agg(
        F.min_by(F.substring("text", 1, 50), F.when(F.col("role") == "user", F.col("turn"))).alias("text")
    )
    qrels = turns.where(F.col("role") == "assistant").select(
        "query_id", F.col("turn").alias("corpus_id")
    )
    # turns of one conversation: at most a few
    longest = Window.partitionBy("query_id").orderBy(F.length("text").desc(), "turn")
    hits = turns.select(
        "query_id", F.col("turn").alias("id"), F.row_number().over(longest).alias("rank")
    ).where(F.col("rank") <= 5)
    means, _ = metrics.evaluate(queries, qrels, hits, (1, 3, 5))
    return means.select(
        "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")], "queries"
    )


def lsh_topk(spark, sf):
    return _shown(
        vectors.lsh_topk(_queries(spark, sf), _points(spark, sf), KNN_K, 64, skip_self=True)
    )


def lsh_recall(spark, sf):
    """Share of the exact best k that ``lsh_topk`` finds with the query's parameters."""
    ids = ["query_id", "id"]
    exact = vectors.cosine_topk(_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True).select(*ids)
    near = lsh_topk(spark, sf).select(*ids, F.lit(1).alias("hit"))
    found = exact.join(near, ids, "left")
    return found.agg(F.lit(KNN_K).alias("k"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def ann_topk(spark, sf):
    """Best vectors by the inverted file: lists probed by measured recall, candidates scored exactly."""
    return _shown(inverted_file.topk(_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True)[0])


def ann_report(spark, sf):
    """What the inverted file finds of the exact answer, and what it scores for it."""
    return inverted_file.report(_queries(spark, sf), _points(spark, sf), KNN_K, skip_self=True)


def hash_encode(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    model = encode.fit_hashed(docs, "text", 256)
    return encode.encode_hashed(docs, model).select("doc_id", "vector")


def unit_vectors(spark, sf):
    """Normalised vectors, summarised: squared length and first weight."""
    points = _points(spark, sf).withColumn("unit", vectors.l2_normalised(F.col("vector")))
    square = F.aggregate("unit", F.lit(0.0), lambda acc, x: acc + x * x)
    return points.select(
        "id", F.round(square, 6).alias("square"), F.round(F.col("unit")[0], 6).alias("first")
    )


# ------------------------------------------------------------------ name search
def _register(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.array("p_type").alias("classes"),
        "p_brand",
    )


def _first_words(spark, sf) -> DataFrame:
    words = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    return words.withColumn("query_id", F.col("name"))


def _all_names(spark, sf) -> DataFrame:
    asked = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return asked.withColumn("query_id", F.col("name"))


def name_contains(spark, sf):
    return names.contains_tier(_first_words(spark, sf), _register(spark, sf)).select(
        "query_id", "rank", "key", "name", "score", "match_type"
    )


def name_fuzzy(spark, sf):
    return names.fuzzy_tier(_all_names(spark, sf), _register(spark, sf)).select(
        "query_id", "rank", "key", "name", "score", "match_type"
    )


def name_pairs(spark, sf):
    pairs = names.similar_pairs(_all_names(spark, sf), _register(spark, sf))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def name_search(spark, sf):
    """Both tiers for every name, filtered by the classes of its cheapest part."""
    register = _register(spark, sf)
    wanted = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.array(F.min_by("p_type", F.struct("p_retailprice", "p_partkey"))).alias("classes")
    )
    queries = wanted.withColumn("query_id", F.col("name"))
    return names.search(queries, register).select(
        "query_id", "rank", "key", "name", "score", "match_type"
    )


def trademark_blocks(spark, sf):
    """Text block of the parts whose name contains a word, one per word."""
    parts = table(spark, sf, "part")
    register = parts.select(
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 10, F.array("p_type")).alias("classes"),
        F.col("p_brand").alias("owner_name"),
        F.lit("VN").alias("owner_country"),
        F.col("p_partkey").cast("string").alias("registration_number"),
        F.when(F.col("p_size") > 20, F.col("p_size").cast("string")).alias("st13"),
        F.when(F.col("p_size") > 30, F.col("p_type")).alias("feature"),
        *[
            F.lit(None).cast("string").alias(c)
            for c in (
                "application_number", "ipr_type", "country_of_filing", "ip_office", "status",
                "application_date", "registration_date", "expiry_date",
            )
        ],
    )
    hits = names.contains_tier(_first_words(spark, sf), register, 5)
    blocks = assemble.contexts(hits, assemble.trademark_block(), "\n\n")
    return blocks.select("query_id", F.col("context"))


# ----------------------------------------------------------------------- merges
def _customer_changes(spark, sf) -> tuple[DataFrame, DataFrame]:
    target = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("amount"),
        F.col("c_mktsegment").alias("segment"),
    )
    source = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("segment"),
        "o_orderdate",
        "o_orderkey",
    )
    return target, source


def merge_overwrite(spark, sf):
    target, source = _customer_changes(spark, sf)
    return merge.merge_overwrite(target, source, ["key"], ["o_orderdate", "o_orderkey"])


def merge_coalesce(spark, sf):
    target, source = _customer_changes(spark, sf)
    return merge.merge_coalesce(target, source, ["key"], ["o_orderdate", "o_orderkey"])


def dedupe_first(spark, sf):
    """Texts are compared by digest, so the shuffle carries no text."""
    digest = F.when(tx.strip(F.col("text")) != "", F.sha2("text", 256))
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.length("text").alias("chars"), digest.alias("digest")
    )
    return merge.dedupe_first(docs, "digest", ["doc_id"]).drop("digest")


def bridge_build(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    links = merge.bridge(parts, "p_partkey", "words", "word")
    more = merge.bridge(
        table(spark, sf, "part").select("p_partkey", F.array(F.lower("p_type")).alias("words")),
        "p_partkey",
        "words",
        "word",
    )
    listed = merge.classes_of(merge.extend_links(links, more), "p_partkey", "word")
    return listed.select("p_partkey", F.array_join("words", ",").alias("words"))


def _sheet_rows(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part")
    return parts.select(
        F.col("p_brand").alias("file"),
        F.col("p_partkey").alias("row"),
        F.col("p_name").alias("Brand name"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ("), F.lower("p_type"), F.lit(") ")).alias("Owner"),
        F.when(F.col("p_size") > 10, F.concat("p_name", F.lit("-"), F.col("p_size"))).alias("ST13"),
        F.concat(F.col("p_size"), F.lit(", x;"), F.col("p_size") + 1).alias("Nice classification"),
        F.when(F.col("p_type") == "SMALL", "VN").otherwise(" US ").alias("IP office"),
    )


def sheet_records_merged(spark, sf):
    unique, _ = sheet_merge.merge_records(sheet_records(_sheet_rows(spark, sf)), ["file", "row"])
    return unique.select(
        "file", "row", "brand_name", "owner_name", "owner_country", "st13", "ip_office",
        F.array_join("nice_classes", "|").alias("nice_classes"),
    )


def sheet_report(spark, sf):
    _, report = sheet_merge.merge_records(sheet_records(_sheet_rows(spark, sf)), ["file", "row"])
    return report


def _records(spark, sf) -> DataFrame:
    """Parts as records: sized ones have an st13, others only a number."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"),
        F.col("p_name").alias("brand_name"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("S"), F.col("p_size"))).alias("st13"),
        F.col("p_brand").alias("registration_number"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("status"),
        F.col("p_retailprice").cast("string").alias("feature"),
    )


def _trademark_register(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("brand_name"),
        F.lower("s_name").alias("brand_name_lower"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("st13"),
        F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("registration_number"),
        *[
            F.lit(None).cast("string").alias(c)
            for c in merge.TRADEMARK_FIELDS
            if c not in ("brand_name", "brand_name_lower", "st13", "registration_number")
        ],
    )


def trademark_merge(spark, sf):
    merged, _ = merge.trademark_upsert(_trademark_register(spark, sf), _records(spark, sf), "row")
    return merged.select("brand_name", "st13", "registration_number", "status")


# ----------------------------------------------------------- routing, benchmark
def _word(word: str) -> str:
    """A whole word between blanks; the same in every regular-expression dialect."""
    return rf"(^|\s){word}(\s|$)"


ROUTING = routing.RoutingRules(
    verdict=(_word("was"), _word("from"), _word("dans"), _word("der"), _word("que"), "which"),
    legal=(_word("the"), _word("of"), _word("la"), _word("und"), "would"),
    trademark=(_word("plate"), r"brand.*check", r"\swith\s.*\sthis\s"),
    advisory=(_word("should"), r"\savec\s.*\spour\s", r"\sby\s.*\sthat\s"),
)


def route_queries(spark, sf):
    asked = table(spark, sf, "conversations").where(F.col("role") == "user")
    return routing.with_route(asked, "text", ROUTING).select(
        "conv_id", "turn", "verdict_score", "legal_score", "trademark_score",
        F.col("advisory").cast("int").alias("advisory"), "route",
    )


def route_defaults(spark, sf):
    """The built-in rule set over all document texts."""
    docs = documents(spark, sf)
    routed = routing.with_route(docs, "text")
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("verdict_score") + F.col("legal_score") + F.col("trademark_score")).alias("score"),
    )


def routed_search(spark, sf):
    """Every user turn goes to the search of its route; its vector is that of the conversation.

    The turns of a conversation ask with one vector, which is searched once.
    """
    asked = table(spark, sf, "conversations").where(F.col("role") == "user")
    routed = routing.with_route(asked, "text", ROUTING).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "route"
    )
    asking = routed.select(F.col("conv_id").alias("query_id")).distinct()
    queries = _all_queries(spark, sf).join(asking, "query_id", "left_semi")
    near = vectors.cosine_topk(queries, _points(spark, sf), 2 * fv.VERDICT_TOP_K).withColumnRenamed("query_id", "conv_id")
    of_turns = routed.select("query_id", "conv_id").join(near.drop("rank"), "conv_id")
    top = vectors.ranked(of_turns, 2 * fv.VERDICT_TOP_K)
    found = retrieval.reranked_by_route(
        top.join(_section_of(spark, sf), "id"),
        routed.select("query_id", "route"),
        {
            "legal": ["legal"],
            "verdict": ["verdict"],
            "trademark": ["trademark"],
            "combined": ["legal", "verdict"],
        },
        {"legal": fv.LEGAL_TOP_K, "verdict": fv.VERDICT_TOP_K, "trademark": fv.LEGAL_TOP_K},
        boosts=[(1, 1.3), (2, 1.1)],
    )
    return _shown(found.select("query_id", "route", "source", "rank", "id", "score"))


#: Questions with the built-in word lists, one for each way to a route; the document's source is added.
QUESTIONS = (
    "Thủ tục gia hạn văn bằng gồm những giấy tờ nào",
    "Bị đơn kháng cáo, tòa án xét phần thiệt hại ra làm sao",
    "Trademark này có xung đột với nhãn hiệu khác không",
    "Nhờ kiểm tra giúp nhãn hiệu",
    "Đối thủ bắt chước bao bì, muốn đòi bồi thường",
    "Nghị định, thông tư cho nguyên đơn được bồi thường bao nhiêu",
    "Phán quyết dẫn thông tư số mấy",
    "Văn phòng mở cửa lúc mấy giờ",
    " ",
)


def route_questions(spark, sf):
    """Routes of questions that meet the built-in rules, one text per document."""
    asked = F.get(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("doc_id") % len(QUESTIONS)).cast("int"))
    text = F.when(asked != " ", F.concat_ws(" ", asked, "source")).otherwise(asked)
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return routing.with_route(docs, "text").select(
        "doc_id", "verdict_score", "legal_score", "trademark_score",
        F.col("advisory").cast("int").alias("advisory"), "route",
    )


def _asked_vectors(spark, sf) -> DataFrame:
    return _queries(spark, sf)


def _source_number() -> Column:
    return F.regexp_extract("source", r"(\d+)", 1).cast("int")


DIGESTED = ("content", "context_before", "context_after")
DIGESTS = [f"{c}_md5" for c in DIGESTED]


def _with_digests(rows: DataFrame) -> DataFrame:
    """Digests in the place of the texts."""
    return rows.withColumns({f"{c}_md5": F.md5(c) for c in DIGESTED}).drop(*DIGESTED)


def _tie() -> Column:
    return F.xxhash64("text", "lang").alias("_tie")


def _positioned(chunks: DataFrame, group: str, order: str) -> DataFrame:
    """Chunks with positions, those of equal order by ``_tie``, so that every scan numbers them alike."""
    segments = chunks.agg(F.count_distinct(F.struct(group, F.expr(f"`{order}` div {sequences.SEGMENT_WIDTH}")))).first()[0]
    return sequences.with_position(chunks, group, order, ties=["_tie"], segments=segments).drop("_tie")


def _statutes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """``(chunks, statutes)``: statutes are sources, their chunks the documents; status, day and type follow the source's number."""
    docs, n = table(spark, sf, "documents"), _source_number()
    statutes = docs.select("source").distinct().select(
        F.col("source").alias("doc_id"), F.upper("source").alias("doc_name"),
        F.concat(F.lit("QD "), n).alias("doc_number"),
        F.when(n % 4 == 0, "code").when(n % 2 == 0, "law").otherwise("decree").alias("doc_type"),
        F.when(n % 5 != 4, F.concat(F.lit("20"), F.lpad((n + 5).cast("string"), 2, "0"), F.lit("-01-01"))).alias("effective_date"),
        F.when(n % 3 == 2, "expired").otherwise("active").alias("status"),
    )
    chunks = _positioned(
        docs.select(
            F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"),
            F.col("text").alias("content"), F.col("lang").alias("dieu"), F.upper("lang").alias("dieu_title"),
            F.lit(None).cast("string").alias("chuong"), _tie(),
        ),
        "doc_id", "chunk_index",
    )
    return chunks, statutes


def legal_search(spark, sf):
    found = retrieval.legal_search(
        _asked_vectors(spark, sf), _points(spark, sf), *_statutes(spark, sf), 5, "2015-06-30", ["law", "decree"],
        derive=_with_digests,
    )
    return _shown(found).select(
        "query_id", "rank", "chunk_id", "score", "doc_id", "doc_name", "doc_number", "doc_type", "effective_date", "dieu",
        "dieu_title", "chunk_index", *DIGESTS,
    )


def _cases(spark, sf) -> tuple[DataFrame, DataFrame]:
    """``(chunks, verdicts)``: verdicts are sources; the language of a document stands for its section."""
    docs, n = table(spark, sf, "documents"), _source_number()
    blank = F.lit(None).cast("string")
    verdicts = docs.select("source").distinct().select(
        F.col("source").alias("verdict_id"), F.concat(n, F.lit("/KDTM")).alias("case_number"),
        F.upper("source").alias("court_name"), blank.alias("judgment_date"), blank.alias("dispute_type"),
        F.when(n % 3 == 0, F.array(F.lit("mark"))).when(n % 3 == 1, F.array(F.lit("patent"), F.lit("design")))
        .otherwise(F.array(F.lit("author"))).alias("ip_types"),
        blank.alias("plaintiff"), blank.alias("defendant"),
        F.when(n % 2 == 0, "first").otherwise("appeal").alias("trial_level"), blank.alias("summary"),
    )
    section = F.when(F.col("lang") == "en", "reasoning").when(F.col("lang") == "fr", "decision_item").otherwise("facts")
    chunks = _positioned(
        docs.select(
            F.col("source").alias("verdict_id"), F.col("doc_id").alias("vchunk_id"), F.col("doc_id").alias("chunk_index"),
            F.col("text").alias("content"), section.alias("section_type"), F.lit(None).cast("int").alias("point_number"),
            blank.alias("party_role"), F.lit(None).cast("int").alias("item_number"), _tie(),
        ),
        "verdict_id", "chunk_index",
    )
    return chunks, verdicts


def verdict_search(spark, sf):
    found = retrieval.verdict_search(
        _asked_vectors(spark, sf), _points(spark, sf), *_cases(spark, sf), 8, ["mark", "design"], "first", derive=_with_digests
    )
    return _shown(found).select(
        "query_id", "rank", "vchunk_id", "score", "verdict_id", "case_number", "court_name", "trial_level", "section_type",
        "chunk_index", *DIGESTS,
    )


FAN_OUT = {"legal": ["legal"], "verdict": ["verdict"], "combined": ["legal", "verdict"]}


def _shared_hits(spark, sf, routed: DataFrame, **texts) -> tuple[DataFrame, DataFrame]:
    return retrieval.shared_search(
        routed, _points(spark, sf), _statutes(spark, sf), _cases(spark, sf), FAN_OUT,
        {"day": "2015-06-30", "doc_types": ["law", "decree"]}, {"ip_types": ["mark", "design"], "trial_level": "first"},
        5, 8, **texts,
    )


def fan_out_search(spark, sf):
    """Queries routed by their number to statutes, verdicts or both; one scan of the vectors, both result blocks."""
    route = F.get(F.array(*[F.lit(r) for r in FAN_OUT]), (F.col("query_id") / 50).cast("int") % 3)
    routed = _asked_vectors(spark, sf).withColumn("route", route)
    laws, cases = _shared_hits(spark, sf, routed, derive=_with_digests)
    both = retrieval.combined_search(
        laws.withColumnsRenamed({"chunk_id": "id", "doc_id": "owner"}), cases.withColumnsRenamed({"vchunk_id": "id", "verdict_id": "owner"})
    )
    routes = if_small(routed.select("query_id", "route"), routed.count())
    return _shown(both.join(routes, "query_id")).select(
        "query_id", "route", "source", "rank", "id", "score", "owner", "doc_type", "trial_level", *DIGESTS
    )


def search_evaluation(spark, sf):
    """Quality of both searches over the first 30 of the asked documents; relevant is the query's label."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    queries = texts.join(labels.withColumnRenamed("id", "query_id"), "query_id").where(F.col("query_id") % 50 == 0)
    laws, cases = _shared_hits(spark, sf, _asked_vectors(spark, sf).withColumn("route", F.lit("combined")), texts=False)
    out = []
    for source, hits in (("legal", laws.select("query_id", "rank", F.col("chunk_id").alias("id"))),
                         ("verdict", cases.select("query_id", "rank", F.col("vchunk_id").alias("id")))):
        means, _ = metrics.evaluate_by_label(queries, labels, hits, (1, 3, 5, 10), limit=30)
        zero = metrics.looks_unmatched(means)
        out.append(means.select(
            F.lit(source).alias("source"), "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")], "queries",
            zero.scalar().cast("int").alias("all_zero"),
        ))
    return out[0].unionByName(out[1])


def _articles(spark, sf) -> DataFrame:
    """Documents as article payloads: the source is the statute, the id the article."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.when(F.col("lang") != "es", F.concat(F.lit(" QD "), F.upper("source"))).alias("doc_number"),
        F.when(
            F.col("n_chars") > 100,
            F.concat(F.lit("Điều "), (F.col("n_chars") % 50).cast("string"), F.lit("A")),
        ).alias("dieu"),
        F.when(F.col("lang") == "fr", F.substring("text", 1, 30)).alias("dieu_title"),
        F.when(F.col("lang") == "de", F.col("source")).alias("doc_name"),
        F.col("text").alias("content"),
    )


def corpus_tables(spark, sf):
    """Documents, chunks and edges of both corpora, from chunk rows that are written once, and how many rows broke a key."""
    folder = f"{session.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    legal_tables = corpus.stored_legal_corpus(_decrees(spark, sf), f"{folder}/legal")
    cases = corpus.stored_verdict_corpus(_judgments(spark, sf), f"{folder}/verdict", size=1_000_000_000)

    def shown(tables, which, kind, src, dst, label):
        return tables.select(
            F.lit(which).alias("corpus"), F.lit(kind).alias("kind"), F.col(src).alias("src"),
            (F.col(dst) if dst else F.lit(None).cast("string")).alias("dst"), label.cast("string").alias("label"),
        )

    none, position = F.lit(None).cast("string"), F.col("position")
    parts = [
        shown(legal_tables.documents, "legal", "document", "doc_id", None, F.concat_ws("|", "doc_type", "issuing_agency", "signing_date", "status")),
        shown(legal_tables.chunks, "legal", "chunk", "chunk_id", "doc_id", position),
        shown(legal_tables.next_edges, "legal", "next", "src", "dst", none),
        shown(cases.documents, "verdict", "document", "verdict_id", None, F.concat_ws("|", "court_name", "judgment_date", "plaintiff", "ip_types_str")),
        shown(cases.chunks, "verdict", "chunk", "vchunk_id", "verdict_id", position),
        shown(cases.next_edges, "verdict", "next", "src", "dst", none),
        shown(cases.typed_edges, "verdict", "typed", "src", "dst", F.col("rel_type")),
    ]
    broken = spark.createDataFrame(
        [(w, "broken", None, None, str(t.rows_read - t.rows_kept)) for w, t in (("legal", legal_tables), ("verdict", cases))], parts[0].schema
    )
    for part in parts:
        broken = broken.unionByName(part)
    return broken


def corpus_ids(spark, sf):
    rows = _articles(spark, sf)
    return rows.select("doc_id", corpus_id(F.col("doc_number"), F.col("dieu")).alias("corpus_id"))


def bench_queries(spark, sf):
    rows, _ = evaluation_set.build(
        _articles(spark, sf), ["doc_id"], max_queries=0, style="title", seed=42
    )
    return rows


def bench_queries_mixed(spark, sf):
    rows, _ = evaluation_set.build(
        _articles(spark, sf), ["doc_id"], max_queries=100, style="mixed", seed=7
    )
    return rows


def bench_manifest(spark, sf):
    good = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    articles = _articles(spark, sf)
    active = articles.join(good, "doc_id", "left_semi").select(
        corpus_id(F.col("doc_number"), F.col("dieu")).alias("corpus_id")
    )
    active = active.where(F.col("corpus_id").isNotNull()).distinct()
    _, counters = evaluation_set.build(articles, ["doc_id"], 1000, "article", 42, active)
    return counters


def seeded_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.seeded_sample(docs, "doc_id", 42, 200)


def seeded_order(spark, sf):
    return sampling.seeded_positions(
        table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42
    )


# -------------------------------------------------------------------- streaming
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    schema = table(spark, folder, name).schema
    # as a pattern: a stream takes no plain path of one file
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


def _arrivals(rows: DataFrame, parts: list, folder: str):
    """Write each part of ``rows`` (a condition) to the folder a stream watches, one after the other."""
    for part in parts:
        rows.where(part).write.mode("append").parquet(folder)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def stream_daily_activity(spark, sf):
    """Events in three arrivals, each with days older than those before it."""
    out = _scratch(spark, "daily")
    third = F.pmod("event_id", F.lit(3))
    parts = [F.day("ts") > 10, (F.day("ts") <= 10) & (third == 0), (F.day("ts") <= 10) & (third > 0)]
    for events in _arrivals(table(spark, sf, "events"), parts, f"{out}/events"):
        run = incremental.log_daily_activity(events, "ts", f"{out}/log", f"{out}/checkpoint")
        run.awaitTermination()
    return incremental.current_days(spark, f"{out}/log")


def stream_chunks(spark, sf):
    """Documents arriving as a stream, cut into chunks and merged by content id."""
    out = _scratch(spark, "chunks")
    docs = _stream(spark, sf, "documents")

    def prepare(batch: DataFrame) -> DataFrame:
        return chunking.marker_chunks(batch, "doc_id", "text", r"\n").withColumn(
            "filename", F.col("doc_id").cast("string")
        )

    incremental.start_log(docs, f"{out}/log", f"{out}/checkpoint", prepare).awaitTermination()
    return incremental.current_chunks(spark, f"{out}/log").drop("filename")


def stream_trademarks(spark, sf):
    """Records in three arrivals into a register; the log is compacted after the second."""
    out = _scratch(spark, "trademarks")
    parts = [F.col("row") % 3 == rest for rest in (2, 0, 1)]
    for number, records in enumerate(_arrivals(_records(spark, sf), parts, f"{out}/records")):
        incremental.start_log(records, f"{out}/log", f"{out}/checkpoint").awaitTermination()
        if number == 1:
            log.compact(spark, f"{out}/log", incremental.latest_records)
            log.sweep(spark, f"{out}/log")
    merged, _ = incremental.current_trademarks(spark, f"{out}/log", _trademark_register(spark, sf))
    return merged.select("brand_name", "st13", "registration_number", "status")


def stream_rolling_messages(spark, sf):
    """Conversations in two arrivals, the later turns first."""
    out = _scratch(spark, "messages")
    parts = [F.col("turn") % 3 > 0, F.col("turn") % 3 == 0]
    for messages in _arrivals(table(spark, sf, "conversations"), parts, f"{out}/messages"):
        incremental.log_last_messages(
            messages, "conv_id", "turn", "text", f"{out}/log", f"{out}/checkpoint", fv.HISTORY_MESSAGES
        ).awaitTermination()
    last = incremental.current_messages(spark, f"{out}/log", "conv_id", "turn", "text", fv.HISTORY_MESSAGES)
    return last.select(
        "conv_id",
        F.array_join(F.transform("orders", lambda o: o.cast("string")), ",").alias("turns"),
        F.md5(F.array_join("contents", "\n")).alias("contents_md5"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, doc_metadata, doc_type_route, section_chunks, packed_chunks, statute_chunks,
        verdict_chunks, statute_articles, verdict_items, page_records, trademark_cards, statute_forms, carry_forward, next_edges, context_window, context_window_2,
        history_last5, session_titles, typed_edges, doc_dimension, duplicate_keys,
        validity_filter, corpus_subset, resume_anti, point_lookup, related_rows, null_profile,
        type_counts, store_stats, daily_activity, prefix_plan, page_listing, retention,
        cascade_delete, knn_topk, knn_filtered, boosted_rerank, hydrate_hits, hits_per_query,
        retrieval_metrics, complete_sections, prompt_blocks, verdict_blocks, evaluation_run, ann_topk, ann_report, lsh_topk, lsh_recall, hash_encode, unit_vectors,
        name_contains, name_fuzzy, name_pairs, name_search, trademark_blocks, merge_overwrite, merge_coalesce,
        dedupe_first, bridge_build, sheet_records_merged, sheet_report, trademark_merge,
        route_queries, route_defaults, route_questions, routed_search, legal_search, verdict_search, fan_out_search, search_evaluation, corpus_tables, corpus_ids, bench_queries,
        bench_queries_mixed, bench_manifest, seeded_sample, seeded_order, stream_daily_activity,
        stream_chunks, stream_trademarks, stream_rolling_messages,
    )
}
