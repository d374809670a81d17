"""Incremental forms of four batch features.

Merges are logged, not rewritten: every micro-batch writes its rows under its
own batch number (a replayed batch overwrites only its own folder), and readers
collapse the log by key with the batch operators. The cost of a batch follows the
batch; ``log.compact`` puts the collapsed rows in the place of finished batches, so that readers
need not collapse the whole log again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexgrove.operators import chunking
from lexgrove.operators.merge import last_by, latest_values, trademark_upsert, valid_records
from lexgrove.operators.sequences import last_n
from lexgrove.streaming.log import BATCH, batch_writer, read_log

def start_log(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    once: bool = True,
) -> StreamingQuery:
    """Log ``prepare(micro-batch)``; ``once`` takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(batch_writer(path, prepare)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


# K1 ------------------------------------------------------------ corpus ingest
def new_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of new ``*.txt`` files, one row per file."""
    files = (
        spark.readStream.option("pathGlobFilter", "*.txt")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder, wholetext=True)
    )
    return files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def ingest_statutes(
    spark: SparkSession, folder: str, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    return start_log(new_texts(spark, folder), path, checkpoint, chunking.statute_chunks, once)


def latest_chunks(log: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What a compaction keeps of a log of chunks."""
    return last_by(log, [key], [BATCH, "filename", "chunk_index"])


def current_chunks(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """Chunks as of the log: the latest batch wins, then the last file name."""
    return latest_chunks(read_log(spark, path), key).drop(BATCH)


# K2 ------------------------------------------------------------ trademark merge
def latest_records(log: DataFrame, order: str = "row") -> DataFrame:
    """What a compaction keeps of a log of records: the last of each st13 and, without one, the latest values of each number.

    All values of a kept row are older than every later batch, so its place inside its batch does not matter.
    """
    placed = F.struct(BATCH, order)
    tidy = valid_records(log.withColumn("_order", placed).drop(BATCH, order), "_order")
    keyed = F.col("st13").isNotNull()
    last = last_by(tidy.where(keyed), ["st13"], ["_order"])
    kept = last.unionByName(latest_values(tidy.where(~keyed), ["registration_number"], ["_order"]))
    return kept.select(F.col(f"_order.{order}").alias(order), *[c for c in kept.columns if c != "_order"], F.col(f"_order.{BATCH}").alias(BATCH))


def current_trademarks(
    spark: SparkSession, path: str, base: DataFrame, order: str = "row"
) -> tuple[DataFrame, DataFrame]:
    """Register after all logged record batches, and ambiguous numbers."""
    log = read_log(spark, path)
    placed = log.withColumn("_order", F.struct(BATCH, order)).drop(BATCH, order)
    return trademark_upsert(base, placed, "_order")


# K3 ------------------------------------------------------------ daily activity
def day_counts(events: DataFrame, ts: str) -> DataFrame:
    """Visits per day among these rows."""
    return events.groupBy(F.to_date(F.col(ts).cast("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("visits")
    )


def log_daily_activity(
    events: DataFrame, ts: str, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Log the day counts of each micro-batch. A count is partial, so a day may be as late as it likes: no state
    is kept and nothing is dropped; ``current_days`` adds the parts up."""
    return start_log(events, path, checkpoint, lambda batch: day_counts(batch, ts), once)


def summed_days(log: DataFrame) -> DataFrame:
    """What a compaction keeps of a log of day counts."""
    return log.groupBy("day").agg(F.sum("visits").alias("visits"), F.max(BATCH).alias(BATCH))


def current_days(spark: SparkSession, path: str) -> DataFrame:
    """``(day, visits)`` over all batches logged so far."""
    log = read_log(spark, path, "day date, visits long")
    return summed_days(log).drop(BATCH)


# K4 ------------------------------------------------------ rolling last messages
def log_last_messages(
    messages: DataFrame, session: str, order: str, content: str, path: str, checkpoint: str, n: int = 5, once: bool = True
) -> StreamingQuery:
    """Log each micro-batch's last ``n`` messages per session; every map task cuts its share of a session first."""

    def prepare(batch: DataFrame) -> DataFrame:
        rows = batch.select(session, F.col(order).cast("long").alias(order), content)
        return last_n(rows, session, [F.col(order), F.col(content)], n)

    return start_log(messages, path, checkpoint, prepare, once)


def latest_messages(log: DataFrame, session: str, order: str, content: str, n: int = 5) -> DataFrame:
    """What a compaction keeps of a log of messages."""
    return last_n(log, session, [F.col(order), F.col(BATCH), F.col(content)], n)


def current_messages(
    spark: SparkSession, path: str, session: str, order: str, content: str, n: int = 5, schema: str | None = None
) -> DataFrame:
    """``(session, orders, contents)`` of the last ``n`` messages over all batches; of equal orders the later batch's
    message is the later one."""
    log = read_log(spark, path, schema)
    newest = latest_messages(log, session, order, content, n)
    # at most n rows of a session
    rows = F.array_sort(F.collect_list(F.struct(order, BATCH, content)))
    return newest.groupBy(session).agg(rows.alias("_rows")).select(
        session, F.col(f"_rows.{order}").alias("orders"), F.col(f"_rows.{content}").alias("contents")
    )
