"""Explicit schemas of the interchange files, and parameter checks."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_STRING_LIST = T.ArrayType(T.StringType())

STATUTE_METADATA = T.StructType(
    _strings(
        "title", "doc_type", "doc_number", "doc_name", "phan", "chuong", "chuong_title", "muc",
        "dieu", "dieu_title",
    )
    + [T.StructField("chunk_index", T.IntegerType())]
    + _strings("chunk_type", "effective_date", "issuing_agency", "signing_date", "status")
    + [T.StructField("is_continuation", T.BooleanType())]
)
VERDICT_METADATA = T.StructType(
    _strings(
        "filename", "case_number", "court_name", "judgment_date", "dispute_type", "trial_level",
        "plaintiff", "defendant", "third_party",
    )
    + [T.StructField("ip_types", _STRING_LIST)]
    + _strings("judges")
    + [T.StructField("law_references", _STRING_LIST)]
    + _strings("summary")
    + [T.StructField("chunk_index", T.IntegerType())]
    + _strings("section_type", "party_role", "point_number", "item_number")
)


def chunk_file(metadata: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField("content", T.StringType()), T.StructField("metadata", metadata)]
    )


QUERIES = T.StructType(_strings("_id", "text"))
QRELS = T.StructType(_strings("query-id", "corpus-id") + [T.StructField("score", T.IntegerType())])
CORPUS = T.StructType(_strings("_id", "title", "text"))
TRADEMARK_RECORD = T.StructType(
    _strings(
        "brand_name", "owner_name", "owner_country", "ip_office", "status", "status_date",
        "registration_number", "application_number", "feature", "ipr_type", "country_of_filing",
        "registration_date", "application_date", "expiry_date", "st13", "crawled_at",
    )
    + [T.StructField("nice_classes", _STRING_LIST)]
)
EFFECTIVE_DATES = T.StructType(
    [
        T.StructField(
            "documents",
            T.ArrayType(
                T.StructType(
                    _strings(
                        "filename", "doc_name", "doc_type", "doc_number", "issuing_agency",
                        "signing_date", "effective_date", "status",
                    )
                )
            ),
        )
    ]
)
MESSAGES = T.StructType(
    _strings("id", "session_id", "role", "content", "route_type")
    + [T.StructField("created_at", T.TimestampType())]
)


def check_range(name: str, value: int, low: int, high: int) -> int:
    """Limits of request parameters; raises on a value outside."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")
    return value
