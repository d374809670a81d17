"""Sources: texts, chunk files, evaluation sets, records, sheets, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove import schemas
from lexgrove.functions import fixed_values as fv
from lexgrove.functions.records import class_list, owner_parts
from lexgrove.functions.text import null_to_blank, strip


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for map-only work that is heavy per row.

    Only a scan with fewer splits than cores is shuffled; a large table already
    has far more splits and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(filename, text)`` of ``*.txt``, one row per file; empty files are skipped."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")).where(
        strip(F.col("text")) != ""
    )


def chunk_file(spark: SparkSession, path: str, metadata: T.StructType) -> DataFrame:
    """Chunk interchange file (one JSON array of content and metadata, read by one task) as flat rows.

    ``chunk_lines`` reads the form with one object per line.
    """
    rows = spark.read.schema(schemas.chunk_file(metadata)).option("multiLine", True).json(path)
    return rows.select("content", "metadata.*")


def chunk_lines(spark: SparkSession, path: str, metadata: T.StructType) -> DataFrame:
    """Chunk interchange with one object per line, as ``writers.chunk_file`` writes it; files can be split."""
    rows = spark.read.schema(schemas.chunk_file(metadata)).json(path)
    return rows.select("content", "metadata.*")


def evaluation_set(
    spark: SparkSession, folder: str, split: str = "test"
) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, text)`` and ``qrels(query_id, corpus_id)`` from JSON lines."""
    queries = spark.read.schema(schemas.QUERIES).json(f"{folder}/queries.jsonl")
    qrels = spark.read.schema(schemas.QRELS).json(f"{folder}/qrels/{split}.jsonl")
    return (
        queries.where(F.col("_id").isNotNull()).select(F.col("_id").alias("query_id"), "text"),
        qrels.where(F.col("query-id").isNotNull())
        .select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"))
        .distinct(),
    )


def evaluation_corpus(
    spark: SparkSession, folder: str, qrels: DataFrame | None = None
) -> DataFrame:
    """``(_id, title, text)``; with ``qrels`` only the judged rows."""
    corpus = spark.read.schema(schemas.CORPUS).json(f"{folder}/corpus.jsonl")
    corpus = corpus.where(F.col("_id").isNotNull())
    if qrels is None:
        return corpus
    return corpus.join(qrels.select(F.col("corpus_id").alias("_id")), "_id", "left_semi")


def trademark_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRADEMARK_RECORD).option("multiLine", True).json(path)


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet exports (CSV with a header row) as trademark records.

    Headers are mapped to fields, unknown ones ignored, missing ones read as
    blank. ``file`` and ``row`` give the reading order: file name, then the
    position of the row in its file.
    """
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("multiLine", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    # a multi-line file is read by one task, so the id rises with the rows of a file
    placed = raw.select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("row"),
    )
    return sheet_records(placed)


def sheet_records(raw: DataFrame, order: tuple[str, ...] = ("file", "row")) -> DataFrame:
    """Rows under sheet headers to records; rows without name and st13 are dropped."""
    present = set(raw.columns)

    def field(header: str):
        return strip(null_to_blank(F.col(f"`{header}`"))) if header in present else F.lit("")

    texts = {name: field(header) for header, name in fv.SHEET_COLUMNS if name != "logo"}
    owner, country = owner_parts(texts.pop("owner_name"))
    classes = class_list(texts.pop("nice_classes"))
    out = raw.select(
        *order,
        *[c.alias(n) for n, c in texts.items()],
        owner.alias("owner_name"),
        country.alias("owner_country"),
        classes.alias("nice_classes"),
    )
    return out.where((F.col("brand_name") != "") | (F.col("st13") != ""))


def payloads(points: DataFrame, vector: str = "vector") -> DataFrame:
    """Everything but the vectors: the Parquet scan does not read that column."""
    return points.drop(vector)


def effective_dates(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar file of document attributes, one row per file name (the last one wins)."""
    docs = spark.read.schema(schemas.EFFECTIVE_DATES).option("multiLine", True).json(path)
    rows = docs.select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")
    rest = [c for c in rows.columns if c not in ("filename", "pos")]
    return (
        rows.where(F.coalesce("filename", F.lit("")) != "")
        .groupBy("filename")
        .agg(F.max_by(F.struct(*rest), "pos").alias("d"))
        .select("filename", "d.*")
    )


def with_overrides(documents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Document attributes replaced by the sidecar's non-null ones, by file name."""
    fields = [c for c in sidecar.columns if c in documents.columns and c != "filename"]
    new = sidecar.select("filename", F.struct(*fields).alias("_new"))
    return documents.join(new, "filename", "left").select(
        *[
            F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in fields else F.col(c)
            for c in documents.columns
        ]
    )


def relational(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give ``partitionColumn`` and bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
