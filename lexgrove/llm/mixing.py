"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The words of a source, its documents in a hashed order and the whole source up to
``REPEAT`` times over, form a stream that is cut into blocks of ``BLOCK`` words. A
source gets as many slots as its target needs blocks. All slots together are
points of the van der Corput sequence: with the slots of the sources laid side by
side over ``[0, 2**k)``, slot ``x`` comes at place ``reverse_bits(x)`` of the
schedule, which spreads every source evenly and gives it exactly its slots. The
r-th slot of a source, by place, is joined with the r-th block of its stream; the
last block is cut so that the source takes its target to the word.

Defined cases: a null or empty text has size 0, is never taken and takes
``taken`` 0; null sources are one source and come last; repeated rows are documents of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import WORD, checkpointed, columns, running_total, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2
BLOCK = 2048
#: Slots that one row is expanded into at once.
_CHUNK = 65_536


def sized(docs: DataFrame, *ids: str) -> DataFrame:
    """``ids``, ``source`` and ``size`` (words) of every row."""
    return columns(docs, *ids, "source", "text").select(
        *ids, F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(text_of(), F.lit(WORD), 0)).cast("long").alias("size")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, source_no, source_size, target, quota`` (target in whole words).

    Weights repeat in the order of the sources by code point. A target stops at
    ``REPEAT`` times the size of its source and what is left over goes to the others
    by weight: with sources ordered by limit per weight, those that stop are the
    first ones, and running totals give the common level of the rest. This table
    has one row per source, so its window is the one place that sees all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(weights, F.col("source_no") % len(WEIGHTS))
    )
    per = per.withColumn("limit", F.col("source_size").cast("double") * REPEAT)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(every) * SHARE)
    # the level if the sources before this one stop; it is highest at the first that does not
    per = per.withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    per = per.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("level") * F.col("weight"), F.col("limit"))
    return per.select(
        "source", F.col("source_no").cast("int").alias("source_no"), "source_size", target.alias("target"),
        F.round(target).cast("long").alias("quota"),
    )


def stream(sizes: DataFrame, plan: DataFrame, *ids: str) -> DataFrame:
    """``sizes`` with its place in the hashed order of its source: words before it as ``start``."""
    name = F.md5(F.concat_ws(" ", *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids]))
    placed = (
        sizes.withColumn("_null", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(plan.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("source"),
                          "source_no", "source_size", "target", "quota"), ["_null", "source"])
        .drop("_null", "source").withColumn("_hash", name)
    )
    place = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    order = [F.col("_hash"), *[F.col(i) for i in ids], F.col("size")]
    return running_total(placed, "source_no", place, order, F.col("size"), "start").drop("_hash")


def blocks(placed: DataFrame, *ids: str) -> DataFrame:
    """``source_no, block, round, ids, size, start, word, length``: the part of a document in each block of its
    source's stream, up to the words the source takes; ``round`` tells the passes over the source apart, ``word``
    counts from the document's start."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))
    here = placed.where("size > 0").select("*", passes.alias("round"))
    here = here.withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
    here = here.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota"))).where("at < end")
    number = F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    cut = here.select("*", number.alias("block"))
    low, high = F.greatest("at", F.col("block") * BLOCK), F.least("end", (F.col("block") + 1) * BLOCK)
    return cut.select("source_no", "block", "round", *ids, "size", "start", (low - F.col("at")).alias("word"), (high - low).alias("length"))


def schedule(plan: DataFrame) -> DataFrame:
    """``source_no, rank, place``: the slots of all sources, ranked per source by their place in the schedule."""
    need = plan.select("source_no", F.ceil(F.col("quota") / BLOCK).alias("n")).where("n > 0")
    total = int(need.agg(F.sum("n")).first()[0] or 0)
    bits = max(16, (total - 1).bit_length()) if total else 16
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    need = need.withColumn("low", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = need.select(
        "source_no", "n", "low", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _CHUNK))).alias("chunk")
    ).repartition("source_no", "chunk")
    inside = F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * _CHUNK) - 1)
    slots = chunks.select("source_no", "low", F.explode(inside).alias("k"))
    slots = slots.select("source_no", (F.col("low") + F.col("k")).alias("x"))
    place = F.conv(F.reverse(F.lpad(F.bin("x"), bits, "0")), 2, 10).cast("long")
    slots = slots.select("source_no", place.alias("place"))
    step = F.shiftright("place", bits - 16)
    return running_total(slots, "source_no", step, [F.col("place")], F.lit(1), "rank").select("source_no", "rank", "place")


def mix(docs: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(pieces, placed)``.

    ``pieces``: ``place, source_no, round, ids, size, start, word, length`` - read in the
    order of ``place`` and then ``start`` they are the mixed words.
    ``placed``: every row of ``docs`` with its size, source and target.
    """
    ids = ids or ("doc_id",)
    sizes = checkpointed(sized(docs, *ids))
    plan = checkpointed(targets(sizes))
    placed = checkpointed(stream(sizes, plan, *ids))
    slots = schedule(plan).withColumnRenamed("rank", "block")
    return blocks(placed, *ids).join(slots.hint("merge"), ["source_no", "block"]), placed


def taken(docs: DataFrame, *ids: str) -> DataFrame:
    """``ids, size, source_size, target, taken`` for every row: words of it that the mix takes, repeats counted.

    ``first_place`` and ``second_place`` tell where in the schedule its first and second pass begin: the earliest
    place of a block that holds words of it; null if that pass takes none. Ordered by place, rows come as mixed.
    """
    ids = ids or ("doc_id",)
    pieces, placed = mix(docs, *ids)
    # a document with words is the only one at its place of its source's stream
    sums = pieces.groupBy("source_no", "start").agg(
        F.sum("length").alias("_taken"),
        *[F.min(F.when(F.col("round") == n, F.col("place"))).alias(f"_place{n}") for n in range(REPEAT)],
    )
    has_words = F.col("size") > 0
    return placed.join(sums.hint("merge"), ["source_no", "start"], "left").select(
        *ids, "size", "source_size", "target",
        F.when(has_words, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
        F.when(has_words, F.col("_place0")).alias("first_place"),
        F.when(has_words, F.col("_place1")).alias("second_place"),
    )
