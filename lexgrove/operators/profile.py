"""Profiles and counts of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.session import cut_lineage


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, nulls, not_nulls, null_pct, level)`` from one pass."""
    low, high = fv.NULL_SHARE_LIMITS
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(columns)],
    )
    rows = counted.select(
        "_total",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"_n_{i}").alias("not_nulls"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("r"),
    ).select("_total", "r.*")
    pct = F.when(F.col("_total") > 0, F.col("nulls") * 100.0 / F.col("_total"))
    return (
        rows.withColumn("nulls", F.col("_total") - F.col("not_nulls"))
        .withColumn("null_pct", pct)
        .select(
            "column_name",
            "nulls",
            "not_nulls",
            "null_pct",
            F.when(F.col("null_pct") < low, "ok")
            .when(F.col("null_pct") < high, "warn")
            .otherwise("bad")
            .alias("level"),
        )
    )


def type_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(dimension, value, rows, pct)`` of each column, from one scan by grouping sets."""
    rows = (
        df.groupingSets([[F.col(c)] for c in columns], *columns)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.grouping(c).alias(f"_g_{c}") for c in columns],
        )
    )
    dimension = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(
        *[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in columns],
        F.lit("unknown"),
    )
    named = rows.select(dimension.alias("dimension"), value.alias("value"), "rows")
    total = F.sum("rows").over(Window.partitionBy("dimension"))
    return named.withColumn("pct", F.col("rows") * 100.0 / total)


def counts_of(named: dict[str, DataFrame | tuple[DataFrame, Column]]) -> DataFrame:
    """``(metric, value)``: row counts, or counts of rows that meet a condition.

    Conditions on one table share a scan: pass the same DataFrame object.
    """
    by_frame: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for metric, spec in named.items():
        df, condition = spec if isinstance(spec, tuple) else (spec, F.lit(True))
        by_frame.setdefault(id(df), (df, []))[1].append((metric, condition))
    parts = []
    for df, metrics in by_frame.values():
        counted = df.agg(*[F.count_if(c).alias(m) for m, c in metrics])
        entries = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _ in metrics]
        )
        parts.append(counted.select(F.explode(entries).alias("r")).select("r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def daily_series(
    events: DataFrame, ts: str, measures: dict[str, Column], days: int = 7
) -> DataFrame:
    """``(day, <measures>)`` for the last ``days`` days up to the newest event, no gaps.

    The newest event is looked up first, so that the scan reads only the events of those days.
    The series has ``days`` rows whatever the size of the events; without events it has none.
    """
    last = events.agg(F.to_date(F.max(ts)).alias("last")).first()["last"]
    first = F.date_sub(F.lit(last), days - 1)
    calendar = events.sparkSession.range(days if last else 0).select(
        F.date_add(first, F.col("id").cast("int")).alias("day")
    )
    # on the raw column, so that it reaches the scan
    recent = events.where(F.col(ts) >= first.cast(events.schema[ts].dataType))
    counted = recent.groupBy(F.to_date(ts).alias("day")).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    return calendar.join(counted, "day", "left").select(
        "day", *[F.coalesce(name, F.lit(0)).alias(name) for name in measures]
    )


def prefix_plan(
    names: DataFrame, name: str, cap: int = fv.PREFIX_CAP, depth: int | None = fv.PREFIX_DEPTH
) -> DataFrame:
    """``(prefix, kind, rows)``: a partition of a name column into prefixes of limited size.

    A prefix is a ``leaf`` if it has at most ``cap`` rows and is split otherwise, one character
    further a level, over the names below split prefixes only. ``ends`` rows count the names that end
    at a split prefix: these are equal, and no prefix divides them. With a ``depth`` the prefixes
    that are too large there are ``overflow`` leaves; without one the plan goes on until none is left,
    at most as many levels as the longest name that is not alone has characters. Names without a first
    letter are ``empty`` and ``null`` rows of their own, so every name is in exactly one row of the plan.
    """
    bare = F.when(F.col(name).isNull(), "null").when(F.length(name) == 0, "empty")
    counted = names.select(F.lower(name).alias("text"), bare.alias("bare")).groupBy("text", "bare").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted)
    rows = counted.where("bare is not null").select(F.lit("").alias("prefix"), F.col("bare").alias("kind"), F.col("n").alias("rows"))
    below, level = counted.where("bare is null"), 1
    while True:
        prefix = F.substring("text", F.lit(1), F.lit(level)).alias("prefix")
        level_rows = below.groupBy(prefix).agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.length("text") == level, F.col("n"))), F.lit(0)).alias("ending")
        )
        level_rows = cut_lineage(level_rows)
        split = (F.col("rows") > cap) & F.lit(level != depth)
        kind = F.when(F.col("rows") <= cap, "leaf").otherwise("overflow")
        rows = rows.unionByName(level_rows.where(~split).select("prefix", kind.alias("kind"), "rows"))
        rows = rows.unionByName(
            level_rows.where(split & (F.col("ending") > 0)).select("prefix", F.lit("ends").alias("kind"), F.col("ending").alias("rows"))
        )
        parents = level_rows.where(split & (F.col("ending") < F.col("rows"))).select("prefix")
        if not parents.take(1):
            return rows
        # a split prefix lies below split ones only, so the names below it are found by it alone
        below = counted.where((F.col("bare").isNull()) & (F.length("text") > level)).withColumn("prefix", prefix)
        below = below.join(parents, "prefix", "left_semi").drop("prefix")
        level += 1


def merge_report(before: DataFrame, after: DataFrame, office: str = "VN") -> DataFrame:
    """Totals of a sheet merge: kept records, records of one office, duplicates."""
    kept = after.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("ip_office") == office).alias("office_records"),
    )
    read = before.agg(F.count(F.lit(1)).alias("_read"))
    return kept.select(
        "total_records",
        "office_records",
        (read.scalar() - F.col("total_records")).alias("duplicates"),
    )


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and the total row count; ``order`` must be unique.

    Spark keeps ``offset + limit`` rows per task, not a full sort.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
