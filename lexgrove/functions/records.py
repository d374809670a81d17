"""Trademark records: owner, class list, dates, keys and blank handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions.text import blank_to_null, null_to_blank, rx, strip


def owner_parts(raw: Column) -> tuple[Column, Column]:
    """Name and country, cut at the last ``(``.

    A country that itself holds parentheses is cut inside: ``X (Korea (Republic
    of))`` gives ``X (Korea`` and ``Republic of``.
    """
    text = strip(null_to_blank(raw))
    cut = rx(r"^(.*)\((.*)$", dot_all=True)
    name = strip(F.regexp_extract(text, cut, 1))
    country = F.btrim(F.regexp_extract(text, cut, 2), F.lit("() "))
    has_country = text.contains("(")
    return F.when(has_country, name).otherwise(text), F.when(has_country, country).otherwise(
        F.lit("")
    )


def class_list(raw: Column) -> Column:
    """Digit-only parts of a list separated by commas, semicolons or blanks."""
    parts = F.split(strip(null_to_blank(raw)), rx(r"[,;\s]+"))
    return F.filter(parts, lambda p: p.rlike(rx(r"^\d+$")))


def status_date(status: Column) -> Column:
    """Text between the first ``(`` and the first ``)``."""
    return F.nullif(F.regexp_extract(status, r"\(([^)]*)\)", 1), F.lit(""))


def record_key(st13: Column, registration_number: Column) -> Column:
    """First non-blank of the two identifiers; null if both are missing."""
    return F.coalesce(blank_to_null(st13), blank_to_null(registration_number))


def stored(c: Column) -> Column:
    """Form in which a text field is stored: trimmed, '' as null."""
    return F.nullif(strip(c), F.lit(""))


def shown(c: Column) -> Column:
    """Form in which a text field is returned: null as ''."""
    return null_to_blank(c)


def shown_list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))
