"""Labelled line tables to records (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.records import owner_parts, status_date
from lexgrove.functions.text import let
from lexgrove.operators.sequences import SEGMENT_WIDTH, carry_forward, with_successor

NAME = "_name"


def lines_of(df: DataFrame, page: str, text: Column, separator: str = "\n") -> DataFrame:
    """``(page, pos, line)`` of the non-blank lines of a text."""
    return df.select(page, F.posexplode(F.split(text, separator)).alias("pos", "line")).where(
        F.trim("line") != ""
    )


def labelled_values(
    lines: DataFrame,
    page: str,
    start_label: str,
    labels: Sequence[str],
    skip: Sequence[str] = (),
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """``(page, record, label, pos, line)``: each value line with its record and label.

    The line before a ``start_label`` line is the name of a new record (label
    ``_name``) unless it starts with a ``skip`` text; a label line introduces the
    lines up to the next label. A record is numbered by the position of its name.
    """
    nxt = with_successor(lines, page, "pos", "line", "_next", width)
    chrome = F.lit(False)
    for prefix in skip:
        chrome = chrome | F.col("line").startswith(prefix)
    is_start = F.coalesce(F.col("_next") == start_label, F.lit(False)) & ~chrome
    is_label = F.col("line").isin(start_label, *labels)
    marked = nxt.withColumns(
        {
            "_start": F.when(is_start, F.col("pos")),
            "_mark": F.when(is_start, F.lit(NAME)).when(is_label, F.col("line")),
            "_is_label": is_label & ~is_start,
        }
    )
    carried = carry_forward(marked, page, "pos", {"_start": "record", "_mark": "label"}, width)
    return carried.where(F.col("record").isNotNull() & ~F.col("_is_label")).select(
        page, "record", "label", "pos", "line"
    )


def first_values(values: DataFrame, page: str, labels: dict[str, str]) -> DataFrame:
    """One row per record with the first value line of each label."""
    return values.groupBy(page, "record").agg(
        *[
            F.min_by("line", F.when(F.col("label") == label, F.col("pos"))).alias(name)
            for label, name in labels.items()
        ]
    )


def records_in_rows(
    df: DataFrame, page: str, text: Column, start_label: str, labels: Sequence[str], skip: Sequence[str] = (), separator: str = "\n"
) -> DataFrame:
    """``(page, record, parts)`` of whole page texts: the records of ``labelled_values`` without a shuffle.

    ``parts`` are ``struct(label, lines)`` in page order. Marks (name lines and labels) are found by position inside
    the row; a part is the slice of lines up to the next mark, a record the slice of parts up to the next name, so
    the work is linear in the page. A null text, or one without a ``start_label`` line after a name, gives no row;
    rows with equal ``page`` are pages of their own. A page must fit in a row; ``labelled_values`` takes longer ones as lines.
    """
    numbered = F.transform(F.split(text, separator), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))

    def marked(rows: Column) -> Column:
        def mark(row: Column, i: Column) -> Column:
            chrome = F.lit(False)
            for prefix in skip:
                chrome = chrome | row["line"].startswith(prefix)
            is_start = F.coalesce(F.get(rows, i + 1)["line"] == start_label, F.lit(False)) & ~chrome
            label = F.when(is_start, F.lit(NAME)).when(row["line"].isin(start_label, *labels), row["line"])
            return F.struct(i.alias("at"), row["pos"].alias("pos"), label.alias("label"))

        marks = F.filter(F.transform(rows, mark), lambda m: m["label"].isNotNull())
        return F.struct(rows.alias("rows"), marks.alias("marks"))

    def parts_of(held: Column) -> Column:
        rows, marks = held["rows"], held["marks"]

        def part(m: Column, k: Column) -> Column:
            low = F.when(m["label"] == NAME, m["at"]).otherwise(m["at"] + 1)  # a name is a value itself
            high = F.coalesce(F.get(marks, k + 1)["at"], F.size(rows))
            values = F.transform(F.slice(rows, low + 1, high - low), lambda r: r["line"])
            return F.struct(m["label"].alias("label"), m["pos"].alias("pos"), values.alias("lines"))

        return F.transform(marks, part)

    def records_of(parts: Column) -> Column:
        named = F.filter(
            F.transform(parts, lambda p, k: F.struct(k.alias("k"), p["label"].alias("label"), p["pos"].alias("pos"))),
            lambda p: p["label"] == NAME,
        )

        def record(starts: Column) -> Column:
            def one(start: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1)["k"], F.size(parts))
                return F.struct(start["pos"].alias("record"), F.slice(parts, start["k"] + 1, end - start["k"]).alias("parts"))

            return F.transform(starts, one)

        return let(named, record)

    lines = F.filter(numbered, lambda r: F.trim(r["line"]) != "")
    found = let(let(let(lines, marked), parts_of), records_of)
    return df.select(page, F.explode(found).alias("_found")).select(page, "_found.record", "_found.parts")


def part_values(parts: Column, label: str) -> Column:
    """All value lines of a label in a record of ``records_in_rows``, in page order."""
    return F.flatten(F.transform(F.filter(parts, lambda p: p["label"] == label), lambda p: p["lines"]))


def trademark_pages(df: DataFrame, page: str, text: Column) -> DataFrame:
    """Result pages, one text each, to trademark records: the rows of ``trademark_cards`` without a shuffle."""
    found = records_in_rows(
        df, page, text, fv.RECORD_START_LABEL, [label for label, _ in fv.RECORD_LABELS], fv.RESULT_PAGE_CHROME
    )
    return _cards(
        found.select(
            page,
            "record",
            *[F.get(part_values(F.col("parts"), label), 0).alias(name) for label, name in _CARD_FIELDS.items()],
            F.flatten(F.transform(part_values(F.col("parts"), "Nice class"), _numbers)).alias("nice_classes"),
        )
    )


_CARD_FIELDS = {NAME: "brand_name", fv.RECORD_START_LABEL: "_owner"} | {
    label: name for label, name in fv.RECORD_LABELS if name != "nice_classes"
}


def _numbers(line: Column) -> Column:
    return F.filter(F.split(line, r"[,\s]+"), lambda p: p.rlike(r"^\d+$"))


def _cards(records: DataFrame) -> DataFrame:
    owner, country = owner_parts(F.col("_owner"))
    return records.withColumns(
        {
            "owner_name": owner,
            "owner_country": country,
            "status_date": status_date(F.col("status")),
            "nice_classes": F.coalesce("nice_classes", F.array().cast("array<string>")),
        }
    ).drop("_owner")


def trademark_cards(lines: DataFrame, page: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Result-page lines to trademark records."""
    labels = [label for label, _ in fv.RECORD_LABELS]
    values = labelled_values(
        lines, page, fv.RECORD_START_LABEL, labels, fv.RESULT_PAGE_CHROME, width
    )
    records = first_values(values, page, _CARD_FIELDS)
    # the few class lines of one record
    classes = (
        values.where(F.col("label") == "Nice class")
        .groupBy(page, "record")
        .agg(F.array_sort(F.collect_list(F.struct("pos", _numbers(F.col("line")).alias("numbers")))).alias("_c"))
        .select(
            page, "record", F.flatten(F.transform("_c", lambda c: c["numbers"])).alias("nice_classes")
        )
    )
    return _cards(records.join(classes, [page, "record"], "left"))
