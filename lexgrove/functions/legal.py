"""Statute documents: metadata of a document and of a chunk, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import (
    any_contains,
    blank_to_null,
    drop_page_lines,
    first_group,
    first_rule,
    head,
    iso_date,
    let,
    rx,
    strip,
    title_case,
)


def clean_document(text: Column) -> Column:
    return drop_page_lines(text, fv.PAGE_LINE_PATTERNS, fv.FORMAT_NOTE_PREFIX)


def _typed(c: Column, rules) -> list[tuple[Column, Column]]:
    out = []
    for groups, label in rules:
        condition = F.lit(True)
        for needles in groups:
            condition = condition & any_contains(c, needles)
        out.append((condition, F.lit(label)))
    return out


def document_type(filename: Column, text: Column) -> Column:
    """File-name rules first, then the head of the text, else the default."""
    by_head = let(
        F.lower(head(text, fv.TYPE_HEADER_CHARS)), lambda top: first_rule(_typed(top, fv.HEADER_TYPES), F.lit(fv.DEFAULT_DOC_TYPE))
    )
    return let(F.lower(filename), lambda name: first_rule(_typed(name, fv.FILE_NAME_TYPES), by_head))


def document_number(text: Column) -> Column:
    found = let(
        head(text, fv.DOC_NUMBER_CHARS), lambda top: first_group(top, fv.DOC_NUMBER_PATTERNS, ignore_case=True)
    )
    return F.coalesce(found, F.lit(""))


def document_name(text: Column, filename: Column) -> Column:
    """Upper-case title under the heading word, else a tidied file name."""
    top = head(text, fv.DOC_NAME_CHARS)
    titled = [
        F.concat(F.lit(prefix), title_case(strip(first_group(top, [pattern]))))
        for prefix, pattern in fv.DOC_NAME_TITLES
    ]
    spaced = F.replace(filename, F.lit("+"), F.lit(" "))
    name = F.coalesce(F.try_url_decode(spaced), spaced)
    name = F.regexp_replace(name, rx(fv.FILE_NUMBER_PREFIX), "")
    name = F.regexp_replace(name, rx(fv.TXT_SUFFIX, ignore_case=True), "")
    return F.coalesce(*titled, name)


def issuing_agency(text: Column) -> Column:
    def named(top: Column) -> Column:
        rules = [(any_contains(top, needles), F.lit(name)) for needles, name in fv.AGENCIES]
        return first_rule(rules, title_case(strip(first_group(top, [fv.AGENCY_FALLBACK]))))

    return let(F.upper(head(text, fv.AGENCY_CHARS)), named)


def signing_date(text: Column) -> Column:
    return let(
        head(text, fv.SIGNING_CHARS),
        lambda top: F.coalesce(*[iso_date(top, p, ignore_case=True) for p in fv.SIGNING_DATE_PATTERNS]),
    )


def effective_date(text: Column, signed: Column) -> Column:
    """Explicit date; else the signing date; else signing date plus N days; else null."""
    explicit = iso_date(text, fv.EFFECTIVE_EXPLICIT, ignore_case=True)
    at_signing = text.rlike(rx(fv.EFFECTIVE_AT_SIGNING, ignore_case=True))
    days = first_group(text, [fv.EFFECTIVE_AFTER_DAYS], ignore_case=True)
    later = F.date_add(
        F.try_to_date(signed, "yyyy-MM-dd"), days.try_cast("int")
    )
    stated = let(
        explicit, lambda day: F.when(day.isNotNull(), day).when(at_signing, signed).otherwise(F.date_format(later, "yyyy-MM-dd"))
    )
    return F.when(text.rlike(rx(fv.EFFECTIVE_PHRASE, ignore_case=True)), stated)


def own_article(text: Column) -> Column:
    """``struct(dieu, dieu_title)`` named in the chunk itself; null if there is none."""
    def found(source: Column, pattern: str, group: int, title: Column) -> Column:
        def titled(article: Column) -> Column:
            return F.when(article != "", F.struct(article.alias("dieu"), title.alias("dieu_title")))

        return let(F.regexp_extract(source, rx(pattern), group), titled)

    def title_of(source: Column, pattern: str, shown) -> Column:
        return let(strip(F.regexp_extract(source, rx(pattern), 2)), shown)

    def loose_title(loose: Column) -> Column:
        stops = F.lit(False)
        for word in fv.ARTICLE_TITLE_STOPS:
            stops = stops | loose.startswith(word)
        return F.when((loose == "") | ~((F.length(loose) < 3) | stops), loose)

    def named(body: Column) -> Column:
        near, wide = head(body, 500), head(body, 1000)
        start = title_of(body, fv.ARTICLE_AT_START, lambda title: F.when(F.length(title) >= 3, title))
        return F.coalesce(
            found(body, fv.ARTICLE_AT_START, 1, start),
            found(near, fv.ARTICLE_AMENDED, 2, F.lit(fv.ARTICLE_AMENDED_TITLE)),
            found(near, fv.ARTICLE_QUOTED, 1, title_of(near, fv.ARTICLE_QUOTED, blank_to_null)),
            found(wide, fv.ARTICLE_ANYWHERE, 1, title_of(wide, fv.ARTICLE_ANYWHERE, loose_title)),
        )

    return let(strip(text), named)


def starts_with_heading(text: Column) -> Column:
    def starts(top: Column) -> Column:
        hit = F.lit(False)
        for word in fv.ARTICLE_HEADING_STARTS:
            hit = hit | top.startswith(word)
        return hit

    return let(F.upper(head(strip(text), 40)), starts)


def chunk_type(text: Column, index: Column, total: Column) -> Column:
    has_article = text.rlike(rx(fv.ARTICLE_MENTION))
    signed = text.rlike(
        rx("(?:" + "|".join(fv.SIGNATURE_PATTERNS) + ")", ignore_case=True)
    )

    def by_top(top: Column) -> Column:
        return first_rule(
            [
                (index == 0, F.lit("header")),
                (
                    (index < 3) & any_contains(top, fv.HEADER_KEYWORDS) & ~has_article,
                    F.lit("header"),
                ),
                (any_contains(top, fv.APPENDIX_KEYWORDS), F.lit("appendix")),
                ((index >= total - 3) & signed, F.lit("signature")),
            ],
            F.lit("content"),
        )

    return let(F.upper(head(text, fv.CHUNK_TYPE_CHARS)), by_top)


def part_heading(text: Column) -> Column:
    return first_group(text, [fv.PART_PATTERN], ignore_case=True)


def chapter_heading(text: Column) -> Column:
    """``struct(chuong, chuong_title)`` of the first matching heading form, else null."""
    def form(pattern: str) -> Column:
        title = strip(F.regexp_extract(text, rx(pattern), 2))
        return let(
            F.regexp_extract(text, rx(pattern), 1),
            lambda chapter: F.when(chapter != "", F.struct(chapter.alias("chuong"), title.alias("chuong_title"))),
        )

    return F.coalesce(*[form(pattern) for pattern in fv.CHAPTER_PATTERNS])


def section_heading(text: Column) -> Column:
    return first_group(text, [fv.SECTION_PATTERN], ignore_case=True)
