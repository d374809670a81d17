"""Documents to chunks.

One document is one row; its chunks are built as an array inside the row and
exploded at the end. Order, totals and carried headings are therefore known
without a shuffle, and the whole stage is map-only: it scales with the number
of documents and has no hot key.

``parity=True`` keeps the historical behaviour of the corpus this follows (lost
leading text, unlimited undivided sections, label suffixes that change the
section type, ``any character + blank`` as a separator); the default follows the
evident intent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import corpus_ids, legal, verdict
from lexgrove.functions import fixed_values as fv
from lexgrove.functions.splitting import split_text
from lexgrove.functions.text import cut_at, head, let, null_to_blank, running, rx, strip


def _exploded(df: DataFrame, keep: list, pieces: Column, value: str) -> DataFrame:
    """One row per array element with its ``chunk_index``.

    The outer form is used and its empty rows are dropped afterwards: for the plain
    form Spark adds a test of the array size in front, which would compute the
    whole array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(pieces).alias("chunk_index", value))
    return rows.where(F.col("chunk_index").isNotNull())


# ------------------------------------------------------------- generic chunkers
def packed_chunks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    separators: Sequence[str] = tuple(fv.PLAIN_SEPARATORS),
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """Size-limited chunks of every document: ``id, chunk_index, content, chunk_id``."""
    pieces = split_text(F.col(text_col), separators, size, overlap)
    return _exploded(docs, [id_col], pieces, "content").withColumn(
        "chunk_id",
        corpus_ids.legal_chunk_id(
            F.col(id_col).cast("string"), F.col("chunk_index"), F.col("content")
        ),
    )


def marker_chunks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    marker: str = r"\n",
    intro_chars: int = 0,
) -> DataFrame:
    """Chunks that start at a marker: ``id, chunk_index, content, chunk_id``.

    Text before the first marker is a chunk if it is longer than ``intro_chars``.
    """
    trimmed = F.transform(cut_at(F.col(text_col), marker), strip)
    kept = F.filter(
        trimmed,
        lambda p, i: (p != "") & ((i > 0) | (F.length(p) > intro_chars)),
    )
    return _exploded(docs, [id_col], kept, "content").withColumn(
        "chunk_id",
        corpus_ids.legal_chunk_id(
            F.col(id_col).cast("string"), F.col("chunk_index"), F.col("content")
        ),
    )


# -------------------------------------------------------------------- statutes
def _carried(chunks: Column) -> Column:
    """Add headings and articles to an array of chunk texts, carried forward.

    Part, chapter (with its title) and section stay until replaced; an article
    is inherited, and marked as continuation, by chunks that name none and do
    not start with a heading.
    """

    def own(text: Column) -> Column:
        return F.struct(
            text.alias("content"),
            legal.part_heading(text).alias("phan"),
            legal.chapter_heading(text).alias("chapter"),
            legal.section_heading(text).alias("muc"),
            legal.own_article(text).alias("article"),
            legal.starts_with_heading(text).alias("headed"),
        )

    carried = ("phan", "chapter", "muc", "article")
    before, after = (F.lit(x) for x in fv.CONTINUED_TITLE)

    def places(rows: Column) -> Column:
        """For every chunk the place of the last one, up to itself, that names each heading; -1 if none does."""
        named = F.transform(
            rows, lambda r, i: F.struct(*[F.when(r[c].isNotNull(), i).otherwise(F.lit(-1)).alias(c) for c in carried])
        )
        nowhere = F.struct(*[F.lit(-1).alias(c) for c in carried])
        latest = lambda a, x: F.struct(*[F.greatest(a[c], x[c]).alias(c) for c in carried])
        return running(named, nowhere, latest)

    def looked_up(held: Column) -> Column:
        rows, at = held["rows"], held["places"]

        def row(c: Column, i: Column) -> Column:
            last = lambda name: F.get(rows, F.get(at, i)[name])[name]
            article = last("article")["dieu"]
            inherits = c["article"].isNull() & article.isNotNull() & ~c["headed"]
            return F.struct(
                i.alias("index"),
                c["content"].alias("content"),
                last("phan").alias("phan"),
                last("chapter")["chuong"].alias("chuong"),
                last("chapter")["chuong_title"].alias("chuong_title"),
                last("muc").alias("muc"),
                F.when(inherits, article).otherwise(c["article"]["dieu"]).alias("dieu"),
                F.when(inherits, F.concat(before, article, after)).otherwise(c["article"]["dieu_title"]).alias("dieu_title"),
                inherits.alias("is_continuation"),
            )

        return F.transform(rows, row)

    return let(let(F.transform(chunks, own), lambda rows: F.struct(rows.alias("rows"), places(rows).alias("places"))), looked_up)


def statute_chunks(
    docs: DataFrame,
    parity: bool = False,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """``(filename, text)`` of statutes to chunks with metadata, end to end.

    Empty documents give no rows. A document in which the structural split finds
    nothing falls back to the plain split, without dates and headings.
    """
    separators = fv.STATUTE_SEPARATORS_PARITY if parity else fv.STATUTE_SEPARATORS
    text = F.col("text")
    clean = docs.select("filename", legal.clean_document(F.col("text")).alias("text"))
    described = clean.withColumns(
        {
            "doc_type": legal.document_type(F.col("filename"), text),
            "doc_number": legal.document_number(text),
            "doc_name": legal.document_name(text, F.col("filename")),
            "signing_date": legal.signing_date(text),
            "issuing_agency": legal.issuing_agency(text),
            "parts": split_text(text, separators, size, overlap),
        }
    ).withColumn("effective_date", legal.effective_date(text, F.col("signing_date")))
    found = described.withColumn("structured", F.size("parts") > 0).withColumn(
        "parts",
        F.when(F.col("structured"), F.col("parts")).otherwise(
            split_text(text, fv.PLAIN_SEPARATORS, size, overlap)
        ),
    )
    rows = _exploded(
        found.withColumn("total", F.size("parts")).drop("text"),
        ["*"],
        _carried(F.col("parts")),
        "c",
    )
    doc_id = F.when(F.col("doc_number") != "", F.col("doc_number")).otherwise(F.col("filename"))
    content = F.col("c.content")
    kind = F.when(
        F.col("structured"), legal.chunk_type(content, F.col("c.index"), F.col("total"))
    ).otherwise("content")

    def structured_only(c: str) -> Column:
        return F.when(F.col("structured"), F.col(c)).alias(c.split(".")[-1])

    return rows.select(
        corpus_ids.legal_chunk_id(doc_id, F.col("c.index"), content, parity).alias("chunk_id"),
        doc_id.alias("doc_id"),
        "filename",
        content.alias("content"),
        F.col("c.index").alias("chunk_index"),
        kind.alias("chunk_type"),
        *[
            structured_only(f"c.{f}")
            for f in ("phan", "chuong", "chuong_title", "muc", "dieu", "dieu_title")
        ],
        F.col("c.is_continuation").alias("is_continuation"),
        "doc_name",
        "doc_type",
        "doc_number",
        *[structured_only(f) for f in ("issuing_agency", "signing_date", "effective_date")],
        F.lit("active").alias("status"),
    )


# -------------------------------------------------------------------- verdicts
def _between(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based, end-exclusive positions, trimmed."""
    return strip(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))))


def _match(text: Column, pattern: str) -> tuple[Column, Column]:
    """0-based start and end of the first match; null if there is none."""
    at = F.nullif(F.regexp_instr(text, F.lit(rx(pattern))), F.lit(0)) - 1
    return at, at + F.length(F.regexp_extract(text, rx(pattern), 0))


def _last_match(text: Column, pattern: str) -> tuple[Column, Column]:
    pieces = cut_at(text, pattern)
    last = F.element_at(pieces, -1)
    at = F.when(F.size(pieces) > 1, F.length(text) - F.length(last))
    return at, at + F.length(F.regexp_extract(last, rx(pattern), 0))


def macro_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``header, facts, reasoning, decision``: the four parts of a verdict.

    The decision starts at its marker within a short distance after the last
    closing formula, else at the last marker that opens a line. Text of a
    missing part moves into the reasoning.
    """
    text = F.col(text_col)
    facts_at, facts_end = _match(text, fv.FACTS_MARKER)
    reason_at, reason_end = _match(text, fv.REASONING_MARKER)
    closing_at, _ = _last_match(text, fv.DECISION_SENTINEL)
    line_at, line_end = _last_match(text, fv.DECISION_LINE_MARKER)
    located = docs.withColumns(
        {
            "_facts_at": facts_at,
            "_facts_end": facts_end,
            "_reason_at": reason_at,
            "_reason_end": reason_end,
            "_closing_at": closing_at,
            "_line_at": line_at,
            "_line_end": line_end,
            "_length": F.length(text),
        }
    )
    after = F.substring(text, F.col("_closing_at") + 1, F.lit(fv.DECISION_LOOKAHEAD_CHARS))
    near_at, near_end = _match(after, fv.DECISION_MARKER)
    located = located.withColumns(
        {
            "_decision_at": F.coalesce(F.col("_closing_at") + near_at, F.col("_line_at")),
            "_decision_end": F.coalesce(F.col("_closing_at") + near_end, F.col("_line_end")),
            "_facts_from": F.coalesce(F.col("_facts_end"), F.lit(0)),
        }
    ).withColumn("_reason_from", F.coalesce(F.col("_reason_end"), F.col("_facts_from")))
    out = located.withColumns(
        {
            "header": null_to_blank(_between(text, F.lit(0), F.col("_facts_at"))),
            "facts": null_to_blank(_between(text, F.col("_facts_from"), F.col("_reason_at"))),
            "reasoning": _between(
                text, F.col("_reason_from"), F.coalesce(F.col("_decision_at"), F.col("_length"))
            ),
            "decision": null_to_blank(_between(text, F.col("_decision_end"), F.col("_length"))),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _labelled(content: Column, label: Column | str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(content.alias("content"), label.alias("label"))


def _non_blank(items: Column) -> Column:
    return F.filter(items, lambda c: c["content"] != "")


def _no_items() -> Column:
    return F.array().cast("array<struct<content:string,label:string>>")


def _starts(text: Column, pattern: str, **flags) -> Column:
    """0-based start positions of all matches of a pattern."""
    lengths = F.transform(cut_at(text, pattern, **flags), lambda p: F.length(p))
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos"))

    def step(acc: Column, n: Column) -> Column:
        pos = acc["pos"] + n
        return F.struct(F.concat(acc["at"], F.array(pos)).alias("at"), pos.alias("pos"))

    # the end of the last piece is the end of the text, not a match
    return F.aggregate(lengths, zero, step, lambda acc: F.slice(acc["at"], 1, F.size(acc["at"]) - 1))


def fact_items(text: Column, parity: bool = False) -> Column:
    """Facts cut at party presentations and lower-court mentions, labelled."""
    groups = [
        (p, label, {"ignore_case": True, "dot_all": True}) for p, label in fv.PARTY_PRESENTATIONS
    ] + [(p, fv.LOWER_COURT_LABEL, {"ignore_case": True}) for p in fv.LOWER_COURT_MENTIONS]

    def marked(order: int, label: str):
        return lambda at: F.struct(
            at.alias("at"), F.lit(order).alias("order"), F.lit(label).alias("label")
        )

    marks = F.flatten(
        F.array(
            *[
                F.transform(_starts(text, pattern, **flags), marked(order, label))
                for order, (pattern, label, flags) in enumerate(groups)
            ]
        )
    )

    def cut(points: Column) -> Column:
        first = F.get(points, F.lit(0))["at"]
        intro = _labelled(_between(text, F.lit(0), first), fv.FACTS_LABEL)
        keeps_intro = first > (fv.FACTS_INTRO_CHARS if parity else 0)
        parts = F.transform(
            points,
            lambda p, i: _labelled(
                _between(
                    text, p["at"], F.coalesce(F.get(points, i + 1)["at"], F.length(text))
                ),
                p["label"],
            ),
        )
        return (
            F.when(F.size(points) == 0, F.array(_labelled(strip(text), fv.FACTS_LABEL)))
            .when(keeps_intro, F.concat(F.array(intro), parts))
            .otherwise(parts)
        )

    return _non_blank(let(F.array_sort(marks), cut))


def point_items(text: Column, parity: bool = False) -> Column:
    """Reasoning cut at ``[n]`` and ``[n.m]`` points."""

    def label(piece: Column) -> Column:
        return F.concat(
            F.lit("["), F.regexp_extract(piece, rx(fv.POINT_MARKER), 1), F.lit("]")
        )

    def cut(pieces: Column) -> Column:
        intro = strip(F.get(pieces, F.lit(0)))
        least = fv.INTRO_CHARS if parity else 0
        points = F.transform(
            F.slice(pieces, 2, F.size(pieces)), lambda p: _labelled(strip(p), label(p))
        )
        return (
            F.when(F.size(pieces) == 1, F.array(_labelled(intro, "")))
            .when(F.length(intro) > least, F.concat(F.array(_labelled(intro, fv.INTRO_LABEL)), points))
            .otherwise(points)
        )

    return _non_blank(let(cut_at(text, fv.POINT_MARKER), cut))


def decision_items(text: Column, parity: bool = False) -> Column:
    """Decision cut by its most frequent numbering style; fee items are marked."""
    styles = [
        (fv.ROMAN_STYLE_PARITY if parity and name == "roman" else pattern, form)
        for name, pattern, form in fv.ITEM_STYLES
    ]
    least = fv.INTRO_CHARS if parity else 0

    def by_style(pattern: str, form: str):
        opening, closing = form.split("%s")
        return lambda pieces: styled(pieces, pattern, opening, closing)

    def styled(pieces: Column, pattern: str, opening: str, closing: str) -> Column:
        def item(piece: Column) -> Column:
            number = F.concat(
                F.lit(opening), F.regexp_extract(piece, rx(pattern), 1), F.lit(closing)
            )
            body = strip(piece)
            fee = head(body, fv.FEE_ITEM_CHARS).rlike(rx(fv.FEE_IN_ITEM, ignore_case=True))
            label = F.when(fee, F.concat(F.lit(fv.FEE_LABEL + " "), number)).otherwise(number)
            return _labelled(body, label)

        intro = strip(F.get(pieces, F.lit(0)))
        items = F.transform(F.slice(pieces, 2, F.size(pieces)), item)
        return F.when(
            F.length(intro) > least,
            F.concat(F.array(_labelled(intro, fv.DECISION_INTRO_LABEL)), items),
        ).otherwise(items)

    def cut(counts: Column) -> Column:
        best = F.array_max(counts)
        fee_at, _ = _match(text, fv.FEE_WORDS)
        before = _between(text, F.lit(0), fee_at)
        undivided = F.when(
            F.length(before) > fv.FEE_SPLIT_CHARS,
            F.array(
                _labelled(before, fv.DECISION_LABEL),
                _labelled(_between(text, fee_at, F.length(text)), fv.FEE_LABEL),
            ),
        ).otherwise(F.array(_labelled(strip(text), "")))
        chain = F.when(best < 2, undivided)
        for i, (pattern, form) in enumerate(styles):
            pieces = cut_at(text, pattern)
            chain = chain.when(counts[i] == best, let(pieces, by_style(pattern, form)))
        return chain.otherwise(_no_items())

    counts = F.array(*[F.regexp_count(text, F.lit(rx(p))) for p, _ in styles])
    return _non_blank(let(counts, cut))


def split_oversized(
    items: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> Column:
    """Items over ``size`` are split again; later parts get ``-p2``, ``-p3`` … labels.

    Items are ``struct(part, content, label, limited)``; ``limited`` items are held
    to the size. ``base`` is added: the label without suffix.
    """

    def sized(item: Column) -> Column:
        def piece(text: Column, label: Column) -> Column:
            return F.struct(
                item["part"].alias("part"),
                text.alias("content"),
                label.alias("label"),
                item["label"].alias("base"),
            )

        def suffixed(text: Column, i: Column) -> Column:
            suffix = F.when(i > 0, F.concat(F.lit("-p"), (i + 1).cast("string"))).otherwise("")
            return piece(text, F.concat(item["label"], suffix))

        long = item["limited"] & (F.length(item["content"]) > size)
        parts = F.transform(
            split_text(item["content"], fv.VERDICT_SEPARATORS, size, overlap), suffixed
        )
        return F.when(long, parts).otherwise(F.array(piece(item["content"], item["label"])))

    return F.flatten(F.transform(items, sized))


def _of_part(part: str, items: Column, limited: Column) -> Column:
    return F.transform(
        items,
        lambda c: F.struct(
            F.lit(part).alias("part"),
            c["content"].alias("content"),
            c["label"].alias("label"),
            limited.alias("limited"),
        ),
    )


def verdict_chunks(
    docs: DataFrame,
    parity: bool = False,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """``(filename, text)`` of verdicts to chunks with metadata, end to end."""
    text = F.col("text")
    repaired = docs.select("filename", verdict.repair_ocr(F.col("text")).alias("text"))
    fields = verdict.metadata(text, F.col("filename"))
    described = repaired.withColumns(fields).withColumn(
        "summary", verdict.summary({name: F.col(name) for name in fields})
    )
    cut = macro_sections(described)
    header = F.when(
        F.col("header") != "", F.array(_labelled(F.col("header"), ""))
    ).otherwise(_no_items())
    cut = cut.withColumns(
        {
            "_header": header,
            "_facts": fact_items(F.col("facts"), parity),
            "_reasoning": point_items(F.col("reasoning"), parity),
            "_decision": decision_items(F.col("decision"), parity),
        }
    )

    def limited(name: str, *whole_labels: str) -> Column:
        """In parity mode a section that was not divided is not held to the size."""
        if not parity:
            return F.lit(True)
        first = F.get(F.col(name), F.lit(0))["label"]
        return F.coalesce(~((F.size(name) == 1) & first.isin(*whole_labels)), F.lit(False))

    items = F.concat(
        _of_part("header", F.col("_header"), F.lit(not parity)),
        _of_part("facts", F.col("_facts"), limited("_facts", fv.FACTS_LABEL)),
        _of_part("reasoning", F.col("_reasoning"), limited("_reasoning", "")),
        _of_part(
            "decision",
            F.col("_decision"),
            limited("_decision", "") & (F.get(F.col("_decision"), F.lit(0))["label"] != fv.DECISION_LABEL)
            if parity
            else F.lit(True),
        ),
    )
    part, label = F.col("c.part"), F.col("c.label")
    deciding = F.col("c.label") if parity else F.col("c.base")
    is_fee = F.lower(label).contains(fv.FEE_LABEL)
    section = (
        F.when((part == "facts") & (deciding == fv.LOWER_COURT_LABEL), "lower_court_decision")
        .when(part == "facts", "fact")
        .when((part == "decision") & is_fee, "court_fee")
        .when(part == "decision", "decision_item")
        .otherwise(part)
    )

    def in_part(name: str, value: Column) -> Column:
        return F.when(part == name, value).otherwise("")

    bare = F.when(is_fee, F.replace(label, F.lit(fv.FEE_LABEL + " "), F.lit(""))).otherwise(label)
    verdict_id = F.when(F.col("case_number") != "", F.col("case_number")).otherwise(
        F.col("filename")
    )
    rows = _exploded(
        cut, ["filename", *fields, "summary"], split_oversized(items, size, overlap), "c"
    )
    return rows.select(
        corpus_ids.verdict_chunk_id(verdict_id, F.col("chunk_index"), F.col("c.content"), parity).alias(
            "vchunk_id"
        ),
        verdict_id.alias("verdict_id"),
        "filename",
        "chunk_index",
        F.col("c.content").alias("content"),
        section.alias("section_type"),
        in_part("facts", label).alias("party_role"),
        in_part("reasoning", label).alias("point_number"),
        in_part("decision", bare).alias("item_number"),
        *fields,
        "summary",
    )
