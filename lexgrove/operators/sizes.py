"""Joins against tables whose row count is known or bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table of narrow rows whose number is proven to be small.

    ``rows`` is an upper bound, such as queries times k. Without a bound, or above
    the limit, Spark chooses the join from its own statistics.
    """
    return F.broadcast(df) if rows is not None and rows <= limit else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has, for a join that repeats each of them many times.

    Spark puts off an expression until its column is read, which in a broadcast join is once for every
    match; dealt rows hold its value. The tasks are not merged by size, as the join makes few bytes many rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
