"""A log of micro-batches that readers collapse, and its compaction.

``path/batch_id=N`` holds the rows of batch N. A compaction writes the collapsed rows of all finished
batches as a snapshot beside them and then replaces the manifest, one small file that names the snapshot
and the last batch in it, by a rename: a reader sees the log either before or after it, never between, and a
compaction that dies leaves only an unnamed folder. Folders that the manifest makes superfluous stay until ``sweep``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"
_MANIFEST, _SNAPSHOTS = "_manifest.json", "_snapshots"


@dataclass(frozen=True)
class Manifest:
    up_to: int
    snapshot: str


class _Files:
    """The files below ``path``, in whatever store Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.path = spark._jvm, spark.sparkContext._gateway, path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def text(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside and rename over, in one step of the store."""
        draft = self.at(f"_{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(draft).toUri(), self.conf)
        context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.at(name)), how)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    text = _Files(spark, path).text(_MANIFEST)
    return Manifest(**json.loads(text)) if text else None


def batch_writer(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """``foreachBatch`` function that logs ``prepare(batch)`` under its batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The snapshot, if there is one, and all rows logged since; none, with this schema, if nothing has arrived yet."""
    known = manifest(spark, path)
    rows = _batches(spark, path)
    if known is not None:
        held = spark.read.parquet(f"{path}/{_SNAPSHOTS}/{known.snapshot}")
        return held if rows is None else held.unionByName(rows.where(F.col(BATCH) > known.up_to), allowMissingColumns=True)
    if rows is None:
        if schema is None:
            raise FileNotFoundError(f"nothing logged in {path}")
        return spark.createDataFrame([], f"{schema}, {BATCH} int")
    return rows


def compact(spark: SparkSession, path: str, collapse: Callable[[DataFrame], DataFrame]) -> Manifest | None:
    """Put ``collapse(log)`` in the place of all finished batches; null if none is new.

    ``collapse`` takes and returns rows of the log with their batch numbers, and must leave every reader's result as it is.
    """
    files, known = _Files(spark, path), manifest(spark, path)
    numbers = [int(m[1]) for n in files.names() if (m := re.fullmatch(rf"{BATCH}=(\d+)", n))]
    done = [n for n in numbers if "_SUCCESS" in files.names(f"{BATCH}={n}")]
    up_to = max(done, default=-1)
    if not done or (known is not None and up_to <= known.up_to):
        return None
    new = Manifest(up_to, f"{up_to}-{uuid.uuid4().hex}")
    collapse(read_log(spark, path).where(F.col(BATCH) <= up_to)).write.parquet(f"{path}/{_SNAPSHOTS}/{new.snapshot}")
    files.replace(_MANIFEST, json.dumps(new.__dict__))
    return new


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove what the manifest has made superfluous; only when no reader that began before the compaction is left."""
    files, known = _Files(spark, path), manifest(spark, path)
    if known is None:
        return []
    old = [n for n in files.names() if (m := re.fullmatch(rf"{BATCH}=(\d+)", n)) and int(m[1]) <= known.up_to]
    old += [f"{_SNAPSHOTS}/{n}" for n in files.names(_SNAPSHOTS) if n != known.snapshot]
    for name in old:
        files.remove(name)
    return old
