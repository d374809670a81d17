"""Sequences: positions, successors, carry-forward, neighbours, last N.

A group (a document, a conversation) may hold a large share of all rows, so no
operator here sorts a whole group in one task. The order column, a whole number,
is cut into segments of ``width``; windows run inside ``(group, segment)``, one
small row per segment passes the state on, and is joined back by an equi-join.
The result equals the plain window over the group, null groups and a null order
(first in its group) included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.operators.sizes import if_small

SEGMENT_WIDTH = 100_000


def _segmented(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_segment", F.expr(f"`{order}` div {width}"))


def _from_segments(df: DataFrame, group: str, state: Column, carried: Column) -> DataFrame:
    """``(group, segment, value)``: ``carried`` evaluated over per-segment ``state``."""
    per_segment = df.groupBy(group, "_segment").agg(state.alias("_state"))
    return per_segment.select(group, "_segment", carried.alias("_carried"))


def _with_segments(seg: DataFrame, passed: DataFrame, group: str) -> DataFrame:
    """``seg`` with ``_carried`` of its segment; null groups and null orders meet as well."""
    named = passed.select(F.col(group).alias("_g"), F.col("_segment").alias("_s"), "_carried")
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col("_segment").eqNullSafe(F.col("_s"))
    return seg.join(named, same).drop("_g", "_s")


def with_position(
    df: DataFrame,
    group: str,
    order: str,
    width: int = SEGMENT_WIDTH,
    name: str = "position",
    ties: Sequence[str] = (),
    segments: int | None = None,
) -> DataFrame:
    """Dense 0-based position of each row in its group; ``order`` is unique per group, or with ``ties``.

    If ``segments``, a bound on the groups' segments, is small, the rows are shuffled once only.
    """
    seg = _segmented(df, order, width)
    inside = Window.partitionBy(group, "_segment").orderBy(order, *ties)
    before = (
        Window.partitionBy(group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = _from_segments(
        seg, group, F.count(F.lit(1)), F.coalesce(F.sum("_state").over(before), F.lit(0))
    )
    return (
        _with_segments(seg.withColumn("_inner", F.row_number().over(inside) - 1), if_small(offsets, segments), group)
        .withColumn(name, F.col("_carried") + F.col("_inner"))
        .drop("_segment", "_inner", "_carried")
    )


def with_successor(
    df: DataFrame, group: str, order: str, value: str, name: str, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Add ``value`` of the next row of the group in order; null for the last row."""
    seg = _segmented(df, order, width)
    inside = Window.partitionBy(group, "_segment").orderBy(order)
    by_segment = Window.partitionBy(group).orderBy("_segment")
    opening = _from_segments(
        seg, group, F.min_by(value, F.struct(order)), F.lead("_state").over(by_segment)
    )
    seg = seg.withColumn("_inner_next", F.lead(value).over(inside)).withColumn(
        "_last", F.lead(F.lit(1)).over(inside).isNull()
    )
    return (
        _with_segments(seg, opening, group)
        .withColumn(name, F.when(F.col("_last"), F.col("_carried")).otherwise(F.col("_inner_next")))
        .drop("_segment", "_inner_next", "_last", "_carried")
    )


def carry_forward(
    df: DataFrame,
    group: str,
    order: str,
    columns: dict[str, str],
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """For each ``source: target``, the last non-null source up to and with the row.

    Several columns that belong together (chapter and its title) are carried as
    one struct column.
    """
    seg = _segmented(df, order, width)
    inside = (
        Window.partitionBy(group, "_segment")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    state = F.struct(
        *[
            F.max_by(source, F.when(F.col(source).isNotNull(), F.struct(order))).alias(target)
            for source, target in columns.items()
        ]
    )
    carried = F.struct(
        *[
            F.last(F.col("_state")[target], ignorenulls=True).over(before).alias(target)
            for target in columns.values()
        ]
    )
    passed = _from_segments(seg, group, state, carried)
    own = {
        target: F.last(source, ignorenulls=True).over(inside)
        for source, target in columns.items()
    }
    joined = _with_segments(seg.withColumns(own), passed, group)
    return joined.withColumns(
        {t: F.coalesce(F.col(t), F.col("_carried")[t]) for t in columns.values()}
    ).drop("_segment", "_carried")


def next_edges(
    chunks: DataFrame, group: str, order: str, chunk_id: str, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """``(src, dst)`` of consecutive chunks of one document."""
    return (
        with_successor(chunks.select(group, order, chunk_id), group, order, chunk_id, "_dst", width)
        .where(F.col("_dst").isNotNull())
        .select(group, F.col(chunk_id).alias("src"), F.col("_dst").alias("dst"))
    )


def context_of(
    hits: DataFrame,
    chunks: DataFrame,
    group: str,
    position: str,
    content: str,
    window: int = 1,
    max_hits: int | None = None,
    own: bool = False,
) -> DataFrame:
    """Add ``context_before`` and ``context_after`` to hits; with ``own`` also their own ``content``.

    Up to ``window`` neighbours on each side, in document order, each followed by
    the separator; null where there is none. ``position`` is dense (see
    ``with_position``). Neighbours are fetched by an equi-join on
    ``(group, position)``: the work follows the number of hits, and a long
    document is never gathered or sorted as a whole. If ``max_hits``, a bound on
    the hits, is small, the chunk texts are not shuffled.
    """
    keys = hits.select(group, position).distinct()
    offsets = [o for o in range(-window, window + 1) if o != 0 or own]
    if not offsets:
        none = F.lit(None).cast("string")
        return hits.withColumns({"context_before": none, "context_after": none})
    wanted = keys.select(
        group,
        F.col(position).alias("_of"),
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_offset"),
    ).withColumn(position, F.col("_of") + F.col("_offset"))
    most = None if max_hits is None else max_hits * len(offsets)
    found = chunks.select(group, position, content).join(
        if_small(wanted, most), [group, position]
    )

    def side(condition: Column) -> Column:
        # at most ``window`` rows per side and key
        rows = F.array_sort(
            F.collect_list(F.when(condition, F.struct("_offset", F.col(content).alias("text"))))
        )
        text = F.array_join(
            F.transform(rows, lambda r: F.concat(r["text"], F.lit(fv.CONTEXT_SEPARATOR))), ""
        )
        return F.when(F.size(rows) > 0, text)

    texts = [F.max(F.when(F.col("_offset") == 0, F.col(content))).alias(content)] if own else []
    if window:
        texts += [side(F.col("_offset") < 0).alias("context_before"), side(F.col("_offset") > 0).alias("context_after")]
    context = found.groupBy(group, F.col("_of").alias(position)).agg(*texts)
    return hits.join(context, [group, position], "left")


def last_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group; ``order`` is ascending and unique.

    The rank filter lets Spark cut each map task's share of a group to ``n`` rows
    before the shuffle, so a very large group costs no more than a small one.
    """
    newest = Window.partitionBy(group).orderBy(*[c.desc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    )
