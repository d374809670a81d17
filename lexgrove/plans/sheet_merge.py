"""Sheet merge end to end: records, first wins per st13, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.operators.merge import dedupe_first
from lexgrove.operators.profile import merge_report
from lexgrove.sources.readers import sheets


def merge_records(records: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unique records and the one-row report."""
    unique = dedupe_first(records, "st13", order)
    return unique, merge_report(records, unique)


def merge_sheets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return merge_records(sheets(spark, folder), ["file", "row"])
