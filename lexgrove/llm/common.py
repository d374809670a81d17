"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.session import cut_lineage, shared_folder, ship_package

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = [
    "SPACE", "WORD", "checkpointed", "columns", "normal_space", "running_total", "shared_folder",
    "ship_package", "shuffle_width", "table", "text_of",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def normal_space(text: Column) -> Column:
    """Each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, SPACE + "+", " ")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: others may be there, under any name, and are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: read again, never recomputed."""
    return cut_lineage(df)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, group: str, place: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Exclusive running total ``name`` of ``value`` inside ``group``, without one task per group.

    ``place`` is an integer from 0 to 65,535 that rises with ``order``. Totals of
    its 256 coarse and 65,536 fine steps are summed first, so that a window never
    holds more than 256 rows or the rows of one fine step.
    """
    from pyspark.sql import Window

    marked = df.withColumn("_fine", place.cast("int")).withColumn("_coarse", F.shiftright("_fine", 8))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    fine = marked.groupBy(group, "_coarse", "_fine").agg(F.sum(value).alias("_sum"))
    coarse = fine.groupBy(group, "_coarse").agg(F.sum("_sum").alias("_all"))
    coarse = coarse.select(
        group, "_coarse", F.coalesce(F.sum("_all").over(before(group).orderBy("_coarse")), F.lit(0)).alias("_base")
    )
    fine = fine.select(
        group, "_coarse", "_fine",
        F.coalesce(F.sum("_sum").over(before(group, "_coarse").orderBy("_fine")), F.lit(0)).alias("_step"),
    ).join(coarse.hint("merge"), [group, "_coarse"])
    fine = fine.select(group, "_fine", (F.col("_base") + F.col("_step")).alias("_before"))
    inner = before(group, "_fine").orderBy(*order)
    return (
        marked.join(fine.hint("merge"), [group, "_fine"])  # it grows with the rows: never broadcast
        .withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_fine", "_coarse", "_before")
    )
