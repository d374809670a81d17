"""Ids: content-based chunk ids, and the document-number + article corpus id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import head, null_to_blank, rx, strip


def content_id(owner: Column, index: Column, content: Column, prefix: str = "", parity: bool = False) -> Column:
    """Hash of owner, position and content; stable across runs. With ``parity`` of the content's head only."""
    hashed = head(content, fv.CHUNK_ID_PREFIX_CHARS) if parity else content
    key = F.concat_ws("_", owner, index.cast("string"), hashed)
    digest = head(F.md5(F.concat(F.lit(prefix), key)), fv.CHUNK_ID_HEX)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def legal_chunk_id(doc_id: Column, index: Column, content: Column, parity: bool = False) -> Column:
    return content_id(doc_id, index, content, parity=parity)


def verdict_chunk_id(verdict_id: Column, index: Column, content: Column, parity: bool = False) -> Column:
    return content_id(verdict_id, index, content, prefix="v_", parity=parity)


def document_number_key(number: Column) -> Column:
    return F.replace(F.lower(strip(null_to_blank(number))), F.lit(" "), F.lit(""))


def article_number(article: Column) -> Column:
    found = F.regexp_extract(F.lower(strip(null_to_blank(article))), rx(r"(\d+[a-z]?)"), 1)
    return F.nullif(found, F.lit(""))


def corpus_id(number: Column, article: Column) -> Column:
    """``number+article``; null if either part is missing."""
    doc = F.nullif(document_number_key(number), F.lit(""))
    return F.concat(doc, F.lit("+"), article_number(article))


def parse_corpus_id(cid: Column, title: Column) -> dict[str, Column]:
    """Document number, article label and title of one evaluation-corpus row.

    The id is cut at its last ``+``; an id without one is a document of its own.
    """
    cut = rx(r"^(.*)\+([^+]*)$", dot_all=True)
    has_article = cid.contains("+")
    label = F.concat(F.lit("Điều "), F.lower(strip(F.regexp_extract(cid, cut, 2))))
    plain = null_to_blank(title)
    headed = rx(r"^\s*Điều\s+\d+[a-z]?\.?\s*(.*)$", ignore_case=True)
    short = F.when(plain.rlike(headed), strip(F.regexp_extract(plain, headed, 1))).otherwise(plain)
    return {
        "doc_number": F.when(has_article, F.regexp_extract(cid, cut, 1)).otherwise(cid),
        "dieu": F.when(has_article, label),
        "dieu_title": F.when(has_article, short).otherwise(plain),
    }
