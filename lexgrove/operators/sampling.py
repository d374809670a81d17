"""Seeded, engine-independent shuffle of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_HEX = 3  # 4096 buckets


def seeded_digest(id_col: Column, seed: int) -> Column:
    """Digest of seed and id; a null id counts as the empty one."""
    return F.md5(F.concat(F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))


def seeded_positions(df: DataFrame, id_col: str, seed: int, name: str = "position") -> DataFrame:
    """1-based position of every row in the order of ``md5(seed || id)``.

    Rows are ranked inside buckets of the digest's first digits; the offsets of
    the buckets come from their counts, a table of at most 4096 rows. No task
    sees more than one bucket.
    """
    keyed = df.withColumn("_digest", seeded_digest(F.col(id_col), seed)).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET_HEX)
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", id_col)
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return (
        keyed.withColumn("_inner", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_inner"))
        .drop("_digest", "_bucket", "_inner", "_offset")
    )


def seeded_sample(df: DataFrame, id_col: str, seed: int, limit: int, name: str = "position") -> DataFrame:
    """The first ``limit`` rows of the seeded order with their position; 0 keeps all."""
    if limit > 0:
        df = df.orderBy(seeded_digest(F.col(id_col), seed), id_col).limit(limit)
    return seeded_positions(df, id_col, seed, name)
