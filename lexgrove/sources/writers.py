"""Sinks. Writers never overwrite a path that is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.merge import merge_overwrite
from lexgrove.operators.metrics import as_record


def chunk_file(chunks: DataFrame, path: str, metadata: list[str]) -> None:
    """Chunk interchange: one JSON object of content and metadata per line, for ``readers.chunk_lines``."""
    chunks.select("content", F.struct(*metadata).alias("metadata")).write.option(
        "ignoreNullFields", False
    ).json(path)


def evaluation_set(rows: DataFrame, folder: str, split: str = "test") -> None:
    """``queries.jsonl`` and ``qrels/<split>.jsonl`` from generated question rows."""
    rows.select(F.col("query_id").alias("_id"), F.col("query_text").alias("text")).write.json(
        f"{folder}/queries.jsonl"
    )
    rows.select(
        F.col("query_id").alias("query-id"),
        F.col("corpus_id").alias("corpus-id"),
        F.lit(1).alias("score"),
    ).write.json(f"{folder}/qrels/{split}.jsonl")


def manifest(counters: DataFrame, folder: str, settings: dict[str, object]) -> None:
    """One row of counters and settings."""
    counters.select(*[F.lit(v).alias(k) for k, v in settings.items()], "*").coalesce(1).write.json(
        f"{folder}/manifest.json"
    )


def evaluation_result(means: DataFrame, per_query: DataFrame, folder: str, settings: dict[str, object]) -> None:
    """``aggregate.json`` (settings beside the means, one line per cut-off) and ``per_query.json``
    (one line per query: precision and recall by cut-off, reciprocal rank), from what ``metrics.evaluate`` returns.

    Settings, such as the measured seconds, must not carry a name that the means have. No query: no line per query.
    """
    clash = set(settings) & set(means.columns)
    if clash:
        raise ValueError(f"settings named like a metric: {sorted(clash)}")
    means.select(*[F.lit(v).alias(k) for k, v in settings.items()], "*").write.json(f"{folder}/aggregate.json")
    as_record(per_query).write.json(f"{folder}/per_query.json")


def merged_points(
    existing: DataFrame, points: DataFrame, key: str, order: list[str], path: str
) -> None:
    """Vector sink: upsert by content id, written to a new path."""
    merge_overwrite(existing, points.select(*existing.columns), [key], order).write.parquet(path)


def points_table(rows: DataFrame, path: str, recreate: bool = False) -> None:
    """Load of benchmark points: append, or drop and recreate."""
    rows.write.mode("overwrite" if recreate else "append").parquet(path)


def relational(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
