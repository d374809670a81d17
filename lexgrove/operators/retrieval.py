"""Retrieval over chunk tables: filters, hydration, boosts, completion, search.

A query table has ``query_id`` and ``vector``; hit tables have ``query_id``,
``rank`` (1-based) and ``score`` next to the chunk columns. Ranked search handles
keys only; text columns are joined to the few rows that survive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.operators.sequences import context_of
from lexgrove.operators.sizes import dealt, if_small
from lexgrove.operators.vectors import cosine_topk, tagged_topk
from lexgrove.session import cut_lineage

LEGAL_HIT_FIELDS = ["content", "dieu", "dieu_title", "chuong", "doc_id", "chunk_index"]
LEGAL_DOC_FIELDS = ["doc_name", "doc_number", "doc_type", "effective_date"]
VERDICT_HIT_FIELDS = [
    "content", "section_type", "point_number", "party_role", "item_number", "verdict_id",
    "chunk_index",
]
VERDICT_DOC_FIELDS = [
    "case_number", "court_name", "judgment_date", "dispute_type", "ip_types", "plaintiff",
    "defendant", "trial_level", "summary",
]


# --------------------------------------------------------------------- filters
def valid_at(
    documents: DataFrame,
    day: Column | str | None = None,
    doc_types: Sequence[str] | None = None,
    status: str = "active",
) -> DataFrame:
    """Documents in force on a day (today by default), optionally of some types."""
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if day is None else day
    day = F.lit(day) if isinstance(day, str) else day
    kept = (F.col("status") == status) & (
        F.col("effective_date").isNull() | (F.col("effective_date") <= day)
    )
    if doc_types:
        kept = kept & F.col("doc_type").isin(*doc_types)
    return documents.where(kept)


def matching_verdicts(
    verdicts: DataFrame, ip_types: Sequence[str] | None = None, trial_level: str | None = None
) -> DataFrame:
    """Verdicts that share a right type and have the trial level, where given."""
    kept = F.lit(True)
    if ip_types:
        kept = kept & F.arrays_overlap("ip_types", F.array(*[F.lit(t) for t in ip_types]))
    if trial_level:
        kept = kept & (F.col("trial_level") == trial_level)
    return verdicts.where(kept)


def of_documents(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Chunks of the given documents (candidate restriction before scoring)."""
    return chunks.join(documents.select(key), key, "left_semi")


def lookup(df: DataFrame, column: str, value, order: str | None = None) -> DataFrame:
    found = df.where(F.col(column) == F.lit(value))
    return found.orderBy(order) if order else found


def related_documents(documents: DataFrame, number: str = "doc_number") -> DataFrame:
    """``(doc_number, related_number, relation)`` for all documents at once.

    ``amends`` names one target; ``amended_by`` lists the numbers that amend the
    row. Both are equi-joins on exploded numbers; duplicates are removed.
    """
    known = documents.select(F.col(number).alias("related_number"))
    amends = documents.select(number, F.col("amends").alias("related_number")).join(
        known, "related_number", "left_semi"
    )
    amended = documents.select(
        F.explode("amended_by").alias(number), F.col(number).alias("related_number")
    ).join(documents.select(number), number, "left_semi")
    both = amends.withColumn("relation", F.lit("amends")).unionByName(
        amended.withColumn("relation", F.lit("amended_by"))
    )
    return both.distinct()


# ------------------------------------------------------------------- hydration
def hydrate(
    hits: DataFrame,
    chunks: DataFrame,
    documents: DataFrame | None,
    chunk_id: str,
    doc_key: str,
    max_hits: int | None = None,
) -> DataFrame:
    """Chunk and document columns of ranked ids; ids without a row are dropped.

    ``max_hits`` bounds the hits (queries times k). If it is small the hits are
    sent to the chunk scan, and the chunk texts are not shuffled.
    """
    rows = chunks.join(if_small(hits.withColumnRenamed("id", chunk_id), max_hits), chunk_id)
    return rows if documents is None else documents.join(if_small(rows, max_hits, 10_000), doc_key)


def hits_per_query(queries: DataFrame, hits: DataFrame, found: str = "id") -> DataFrame:
    """Number of hits of every query, 0 where nothing was found."""
    counts = hits.groupBy("query_id").agg(F.count(found).alias("_n"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("_n", F.lit(0)).alias("total_found")
    )


def boosted(
    hits: DataFrame,
    k: int,
    section: str = "section_type",
    boosts: Sequence[tuple[object, float]] = tuple(fv.SECTION_BOOSTS),
) -> DataFrame:
    """Multiply scores by section, rank again (earlier rank first on ties), cut to k."""
    factor = F.lit(1.0)
    for value, weight in boosts:
        factor = F.when(F.col(section) == F.lit(value), F.lit(weight)).otherwise(factor)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_first_rank")
    return (
        hits.withColumn("score", F.col("score") * factor)
        .withColumnRenamed("rank", "_first_rank")
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .drop("_first_rank")
    )


def complete_sections(
    hits: DataFrame,
    chunks: DataFrame,
    case: str,
    section: str,
    chunk_id: str,
    required: Sequence[str] = fv.KEY_SECTIONS,
    order: str = "chunk_index",
    max_hits: int | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All chunks of the required sections that a hit case lacks among its hits.

    Returns only the added rows ``(query_id, <chunk columns>, score, extra_rank)``
    in the order of case and index. Cases of a query are few (they come from its
    hits); sections are matched by an equi-join.

    Queries that hit a long case all get its chunks, so the rows are many more than the chunks.
    They are not sorted: the chunks of a case are numbered once, by section, and a query adds up
    the numbers of the sections it lacks. ``attach`` adds columns to the chunks (their texts,
    say) before they are repeated for the queries.
    """
    required = list(dict.fromkeys(required))
    present = hits.select("query_id", case, section).where(
        F.col(case).isNotNull() & (F.col(case) != "")
        if dict(hits.dtypes)[case] == "string"
        else F.col(case).isNotNull()
    )
    needed = (
        present.select("query_id", case)
        .distinct()
        .withColumn(section, F.explode(F.array(*[F.lit(s) for s in required])))
    )
    # a few rows per query, which several joins below read
    missing = cut_lineage(needed.join(present, ["query_id", case, section], "left_anti"))
    most = None if max_hits is None else max_hits * len(required)
    is_section = [F.col(section) == F.lit(s) for s in required]
    bit = F.coalesce(*[F.when(own, F.lit(1 << i)) for i, own in enumerate(is_section)])

    def over_lacking(columns: str) -> Column:
        """Sum of the numbered columns over the sections that the query lacks."""
        parts = [F.when(F.col("_lacks").bitwiseAND(1 << i) != 0, F.col(f"{columns}{i}")).otherwise(0) for i in range(len(required))]
        return sum(parts[1:], parts[0])

    # one row per query and case: what it lacks, as bits
    lacking = missing.groupBy("query_id", case).agg(F.bit_or(bit).alias("_lacks"))
    listed = chunks.join(if_small(missing.select(case, section).distinct(), most), [case, section], "left_semi")
    up_to = Window.partitionBy(case).orderBy(order, chunk_id).rowsBetween(Window.unboundedPreceding, 0)
    numbered = listed.withColumns({f"_n{i}": F.count_if(own).over(up_to) for i, own in enumerate(is_section)})
    totals = listed.groupBy(case).agg(*[F.count_if(own).alias(f"_t{i}") for i, own in enumerate(is_section)])
    before = Window.partitionBy("query_id").orderBy(case).rowsBetween(Window.unboundedPreceding, -1)
    lacking = lacking.join(totals, case).select(
        "query_id", case, "_lacks", F.coalesce(F.sum(over_lacking("_t")).over(before), F.lit(0)).alias("_base")
    )

    def placed(rows: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        lacks = F.col("_lacks").bitwiseAND(bit) != 0
        return rows.join(if_small(queries, most), keys).where(lacks).withColumn("_place", F.col("_base") + over_lacking("_n"))

    # chunks that are hits themselves, in another section or case, take no place
    own_hits = hits.select("query_id", chunk_id).distinct()
    held = numbered.select(case, section, chunk_id, *[f"_n{i}" for i in range(len(required))]).join(if_small(own_hits, max_hits), chunk_id)
    gone = placed(held, lacking, ["query_id", case]).groupBy("query_id").agg(F.collect_list("_place").alias("_gone"))
    rows = numbered if attach is None else attach(numbered)
    added = placed(rows, lacking.join(gone, "query_id", "left"), [case])
    added = added.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("_place")))
    # how many of them are before the place; not by ``filter``, which Spark interprets and thus copies each row once more
    passed = F.array_position(F.sort_array(F.array_append("_gone", F.col("_place"))), F.col("_place")) - 1
    rank = F.col("_place") - F.when(F.col("_gone").isNull(), 0).otherwise(passed)
    return added.select(
        "query_id", *chunks.columns, *[c for c in rows.columns if c not in numbered.columns],
        F.lit(fv.COMPLETION_SCORE).alias("score"), rank.cast("int").alias("extra_rank"),
    )


# -------------------------------------------------------------------- searches
def _candidates(vectors: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return vectors if allowed is None else vectors.join(allowed, "id", "left_semi")


def legal_search(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    k: int = fv.LEGAL_TOP_K,
    day: str | None = None,
    doc_types: Sequence[str] | None = None,
    status: str = "active",
    prefilter: bool = True,
    context_window: int = 1,
    ids_only: bool = False,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Statute search of a table of queries; chunks need a dense ``position``. ``derive`` as in ``_with_texts``."""
    allowed = legal_candidates(chunks, documents, day, doc_types, status) if prefilter else None
    top = cosine_topk(queries, _candidates(vectors, allowed), k)
    return top if ids_only else legal_hits(top, chunks, documents, queries.count() * k, context_window, derive=derive)


def legal_candidates(
    chunks: DataFrame, documents: DataFrame, day: str | None = None, doc_types: Sequence[str] | None = None, status: str = "active"
) -> DataFrame:
    """Ids of the chunks whose statute meets the filters."""
    valid = valid_at(documents, day, doc_types, status)
    return of_documents(chunks, valid, "doc_id").select(F.col("chunk_id").alias("id"))


def _with_texts(
    rows: DataFrame, chunks: DataFrame, group: str, window: int, derive: Callable[[DataFrame], DataFrame] | None, most: int | None = None
) -> DataFrame:
    """Chunk rows with their content and, with a window, neighbouring texts; ``derive`` then makes other columns of
    these, while a chunk that several queries get is still one row or few."""
    rows = context_of(rows, chunks, group, "position", "content", window, most, own=True)
    return rows if derive is None else derive(rows)


def legal_hits(
    top: DataFrame, chunks: DataFrame, documents: DataFrame, most: int, context_window: int = 1, texts: bool = True,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked ids (at most ``most``) with their chunk, document and, with ``texts``, own and neighbouring texts."""
    hits = hydrate(
        top,
        chunks.select("chunk_id", "position", *[c for c in LEGAL_HIT_FIELDS if c != "content"]),
        documents.select("doc_id", *LEGAL_DOC_FIELDS),
        "chunk_id",
        "doc_id",
        most,
    )
    return _with_texts(hits, chunks, "doc_id", context_window, derive, most) if texts else hits


def verdict_search(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    verdicts: DataFrame,
    k: int = fv.VERDICT_TOP_K,
    ip_types: Sequence[str] | None = None,
    trial_level: str | None = None,
    prefilter: bool = True,
    boost: bool = True,
    context_window: int = 1,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Verdict search: over-fetch, boost, cut, complete key sections, add context. ``derive`` as in ``_with_texts``."""
    allowed = verdict_candidates(chunks, verdicts, ip_types, trial_level) if prefilter and (ip_types or trial_level) else None
    top = cosine_topk(queries, _candidates(vectors, allowed), k * 2 if boost else k)
    return verdict_hits(top, chunks, verdicts, queries.count() * k * 2, k, boost, context_window, derive=derive)


def verdict_candidates(
    chunks: DataFrame, verdicts: DataFrame, ip_types: Sequence[str] | None = None, trial_level: str | None = None
) -> DataFrame:
    """Ids of the chunks whose verdict meets the filters."""
    chosen = matching_verdicts(verdicts, ip_types, trial_level)
    return of_documents(chunks, chosen, "verdict_id").select(F.col("vchunk_id").alias("id"))


def verdict_hits(
    top: DataFrame, chunks: DataFrame, verdicts: DataFrame, most: int, k: int = fv.VERDICT_TOP_K, boost: bool = True,
    context_window: int = 1, texts: bool = True, derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked ids (at most ``most``) boosted and cut to ``k``, with what completes their cases and, with ``texts``,
    own and neighbouring texts. Texts are joined to chunks, once each, and not to the rows of all queries."""
    details = chunks.select("vchunk_id", "position", *[c for c in VERDICT_HIT_FIELDS if c != "content"]).join(
        verdicts.select("verdict_id", *VERDICT_DOC_FIELDS), "verdict_id"
    )
    hits = hydrate(top, details, None, "vchunk_id", "verdict_id", most)
    if boost:
        hits = boosted(hits, k)
    hits = cut_lineage(hits)  # at most ``most`` rows, which several joins read
    with_texts = lambda rows, n=None: _with_texts(rows, chunks, "verdict_id", context_window, derive, n) if texts else rows
    # what is derived is worked out once a chunk, not once for every query that gets the chunk
    once = (lambda rows: dealt(with_texts(rows), "vchunk_id")) if texts and derive is not None else with_texts
    extra = complete_sections(
        hits, details, "case_number", "section_type", "vchunk_id", max_hits=most, attach=once
    )
    last = if_small(hits.groupBy("query_id").agg(F.max("rank").alias("_last")), most)
    extra = extra.join(last, "query_id").withColumn("rank", F.col("_last") + F.col("extra_rank"))
    shown = with_texts(hits, most)
    return shown.unionByName(extra.select(*shown.columns))


def shared_search(
    routed: DataFrame, vectors: DataFrame, legal: tuple[DataFrame, DataFrame], verdict: tuple[DataFrame, DataFrame],
    sources: dict[str, Sequence[str]], legal_filters: dict | None = None, verdict_filters: dict | None = None,
    legal_k: int = fv.LEGAL_TOP_K, verdict_k: int = fv.VERDICT_TOP_K, context_window: int = 1, texts: bool = True,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Statute hits and verdict hits of routed queries ``(query_id, route, vector)`` from one scan of the vectors.

    ``sources`` lists the sources (``legal``, ``verdict``) of each route; queries of other routes get no hits. A source
    is a tag: every vector carries the tags whose filters its chunk meets, every query those of its route, and only equal
    tags meet. The rows are those of ``legal_search`` and ``verdict_search`` over the queries routed there.
    ``legal`` and ``verdict`` are ``(chunks, documents)``. Without ``texts`` hits have no texts; ``derive`` as in ``_with_texts``.
    """
    listed = F.create_map(*[x for r, names in sources.items() for x in (F.lit(r), F.array(*[F.lit(n) for n in names]))])
    asked = routed.select("query_id", "vector", F.explode(F.try_element_at(listed, F.col("route"))).alias("tag"))
    tagged = vectors
    for name, allowed in (
        ("legal", legal_candidates(*legal, **(legal_filters or {}))), ("verdict", verdict_candidates(*verdict, **(verdict_filters or {})))
    ):
        tagged = tagged.join(allowed.distinct().withColumn(f"_{name}", F.lit(name)), "id", "left")
    tagged = tagged.select("id", "vector", F.array_compact(F.array("_legal", "_verdict")).alias("tags"))
    top = tagged_topk(asked, tagged, {"legal": legal_k, "verdict": 2 * verdict_k})
    n = routed.count()
    of = lambda tag: top.where(F.col("tag") == tag).drop("tag")
    return (
        legal_hits(of("legal"), *legal, n * legal_k, context_window, texts, derive),
        verdict_hits(of("verdict"), *verdict, n * verdict_k * 2, verdict_k, True, context_window, texts, derive),
    )


def reranked_by_route(
    top: DataFrame,
    routes: DataFrame,
    sources: dict[str, list[str]],
    limits: dict[str, int],
    boosted_source: str = "verdict",
    section: str = "section_type",
    boosts: Sequence[tuple[object, float]] = tuple(fv.SECTION_BOOSTS),
) -> DataFrame:
    """Result sets of routed queries from one vector search.

    ``top`` holds the hits of all queries, fetched deep enough for the largest
    set; ``routes(query_id, route)``. A route lists its ``sources``; each source
    has its own limit, and one of them is boosted by section before the cut. The
    vectors are thus scanned once for all routes.
    """
    listed = F.create_map(
        *[x for r, names in sources.items() for x in (F.lit(r), F.array(*[F.lit(n) for n in names]))]
    )
    limit = F.create_map(*[x for n, k in limits.items() for x in (F.lit(n), F.lit(k))])
    factor = F.lit(1.0)
    for value, weight in boosts:
        factor = F.when(F.col(section) == F.lit(value), F.lit(weight)).otherwise(factor)
    score = F.when(F.col("source") == boosted_source, F.col("score") * factor).otherwise(
        F.col("score")
    )
    by_score = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "_first_rank")
    return (
        top.join(routes, "query_id")
        .withColumn("source", F.explode(listed[F.col("route")]))
        .withColumn("score", score)
        .withColumnRenamed("rank", "_first_rank")
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= limit[F.col("source")])
        .drop("_first_rank")
    )


def combined_search(legal_hits: DataFrame, verdict_hits: DataFrame) -> DataFrame:
    """Both result sets side by side, told apart by ``source``."""
    return legal_hits.withColumn("source", F.lit("legal")).unionByName(
        verdict_hits.withColumn("source", F.lit("verdict")), allowMissingColumns=True
    )


def legal_sources(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "doc_name", "doc_type", "doc_number", "dieu", "dieu_title", "score"
    )


def verdict_sources(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "case_number", "court_name", "judgment_date", "dispute_type",
        F.coalesce("ip_types", F.array().cast("array<string>")).alias("ip_types"),
        "section_type", F.round("score", 4).alias("score"),
    )
