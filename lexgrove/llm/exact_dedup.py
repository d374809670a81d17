"""Exact duplicates: binary-fuse screens over immutable snapshots, exact buckets behind them.

A snapshot is written once: its distinct digests with the row that stays (the
exact buckets) and, for each shard of the digest space, a static binary-fuse
filter. An incoming batch is grouped by digest on its own, so copies inside the
batch meet there; its distinct digests are screened shard by shard, and only
positives are joined with the exact buckets and compared byte by byte.

Defined cases: a null text counts as empty; among equal texts the smallest
doc_id stays, null ids last; of repeated rows with that doc_id one is kept;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm import fuse_filter
from lexgrove.llm.common import checkpointed, columns, normal_space, ship_package, text_of

#: Digests of one shard, which one task holds, and the number of shards at least.
SHARD_KEYS = 500_000
LEAST_SHARDS = 1024


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every row: SHA-256 of the text with white space normalised."""
    return columns(docs, "doc_id", "text").select("doc_id", F.sha2(normal_space(text_of()), 256).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """``(digest, keep_id, n)``; copies are combined before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


class Snapshot:
    """Exact buckets and filters of one immutable set of rows."""

    def __init__(self, rows: DataFrame):
        ship_package(rows.sparkSession)
        self.buckets = checkpointed(grouped(rows))
        self.shards = max(LEAST_SHARDS, -(-self.buckets.count() // SHARD_KEYS))
        self.filters = checkpointed(
            keyed(self.buckets, self.shards).groupBy("shard").applyInPandas(_filter_of, "shard int, filter binary")
        )

    def screened(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch(digest, ...)``, one per digest, that the filters let pass."""
        asked = keyed(batch.select("digest"), self.shards)
        passed = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_passed, "digest string")
        return batch.join(passed, "digest", "left_semi")


def keyed(rows: DataFrame, shards: int) -> DataFrame:
    """digest, its first 64 bits as ``key``, and ``shard``."""
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return rows.select("digest", key.alias("key"), F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))


def _filter_of(frame: pd.DataFrame) -> pd.DataFrame:
    keys = frame["key"].to_numpy(np.int64).astype(np.uint64)
    return pd.DataFrame({"shard": frame["shard"].iloc[:1], "filter": [fuse_filter.build(keys)]})


def _passed(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if asked.empty or filters.empty:
        return pd.DataFrame({"digest": pd.Series([], dtype=object)})
    keys = asked["key"].to_numpy(np.int64).astype(np.uint64)
    hits = fuse_filter.contains(bytes(filters["filter"].iloc[0]), keys)
    return asked.loc[hits, ["digest"]]


def check_bytes(docs: DataFrame, pairs: DataFrame) -> None:
    """Compare the texts of ``pairs(digest, a, b)`` (doc_ids of both sides) byte by byte; raise on a difference.

    A digest that stands for two texts has not been seen; a job that met one
    must stop rather than drop a text.
    """
    wanted = pairs.select("digest", F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null").distinct()
    texts = columns(docs, "doc_id", "text").join(wanted, "doc_id").select("digest", normal_space(text_of()).alias("text"))
    texts = texts.where(F.sha2("text", 256) == F.col("digest"))  # a repeated id may have other texts too
    differ = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high")
    if differ.take(1):
        raise ValueError("two different texts have one SHA-256 digest")


def against_snapshot(docs: DataFrame, batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``(digest, keep_id, n)`` of a batch together with what the snapshot holds of the same texts.

    ``docs`` has the texts of both, for the byte check of what meets.
    """
    new = checkpointed(grouped(batch))
    positive = snapshot.screened(new).select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    met = checkpointed(positive.join(snapshot.buckets, "digest"))  # false positives end here
    check_bytes(docs, met.select("digest", F.col("keep_id").alias("a"), F.col("new_id").alias("b")))
    met = met.select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.col("new_n")).alias("n"))
    other = new.join(met, "digest", "left_anti")
    return met.unionByName(other)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    The rows up to the middle of the id range are the snapshot, the others the
    incoming batch.
    """
    rows = checkpointed(digests(docs))
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = None if ends["low"] is None else (int(ends["low"]) + int(ends["high"])) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    snapshot = Snapshot(rows.where(old))
    merged = against_snapshot(docs, rows.where(~old), snapshot)
    groups = checkpointed(merged.unionByName(snapshot.buckets.join(merged, "digest", "left_anti")))
    # repeated rows: the copies of the row that stays are told apart by their number
    twice = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    other = twice.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    single = rows.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_anti")
    repeated = twice.select(
        "doc_id", "digest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    every = single.withColumn("copy", F.lit(1)).unionByName(repeated)
    return every.join(groups, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
