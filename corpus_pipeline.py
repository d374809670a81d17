"""A training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from lexgrove.llm.common import checkpointed, shared_folder, text_of
from lexgrove.llm.queries import tokenizer_file

#: Packing has no SQL form (byte-level BPE); the run is tested against brute force instead.
ORACLE_SQL = None


def opened(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with numbered columns, and their names, beside the columns that operators read.

    So a column of any name can be carried through a stage and never meets one that the stage computes.
    """
    numbered = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*numbered)
    read = {n: numbered[docs.columns.index(n)] for n in ("doc_id", "text", "lang", "source") if n in docs.columns}
    return rows.select("*", *[F.col(c).alias(n) for n, c in read.items()]), numbered


def only(docs: DataFrame, digest: Column, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` named in ``chosen(doc_id, digest)``; of rows with equal names one, whichever comes first."""
    rows, numbered = opened(docs)
    narrow = rows.select(*numbered, "doc_id", digest.alias("digest"))
    named = chosen.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    kept = narrow.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select(*numbered).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Collection[str] | None = None) -> DataFrame:
    """Documents whose predicted language is clear and, with ``wanted``, one of these.

    A text that is null or has no letter is rejected, and one whose two nearest codewords are about as near.
    Repeated rows stay or go together. Where no row teaches a language, only texts without letters go.
    """
    rows, numbered = opened(docs)
    model = language_id.fit(rows)
    if not model.languages:
        return docs.where(text_of("`text`").rlike(r"\p{L}"))
    said = language_id.identify(rows, model, *numbered, names=("said", "score", "unclear"))
    clear = (F.col("said") != language_id.UNKNOWN) & ~F.col("unclear")
    if wanted is not None:
        clear &= F.col("said").isin(*wanted)
    return said.where(clear).select(*numbered).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the smallest doc_id, one without doc_id only if all are.

    Null and empty texts are equal texts. Of rows with that doc_id and text one stays, whatever their other columns hold.
    """
    kept = exact_dedup.deduplicate(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return only(docs, F.sha2(exact_dedup.normal_space(text_of("`text`")), 256), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id, a null one last, then by digest.

    The rule is operator 3's, at most 4 of 64 bits over 4-word shingles; it finds close copies. Of edited copies with
    a Jaccard similarity of 0.8 to 0.9 of their 5-word shingles, most stay (figures in the README). Texts without words
    have one fingerprint and so are one component. Of rows with one doc_id and text one stays.
    """
    named, _ = opened(docs)
    digest = F.sha2(text_of("`text`"), 256)
    rows = checkpointed(simhash_dedup.with_fingerprint(named.select("doc_id", "text", digest.alias("digest")), ["doc_id", "digest"]))
    roots = simhash_dedup.fingerprint_roots(rows.select("fp").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    first = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return only(docs, digest, checkpointed(first.select("first.doc_id", "first.digest")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule: its words of a document, divided by
    its size and rounded, give 0, 1 or 2 whole copies. At most a document or two of a source are rounded.

    A copy stands where the schedule first takes words of that pass over its source; rows are dealt to files by
    ranges of places and sorted inside, copies of one place by doc_id and text. A null source is a source; documents
    without words are taken 0 times. Rows with one doc_id and text are taken equally often, by the mean of what the
    mix takes of each, and stand where the earliest of them does.
    """
    rows, numbered = opened(docs)
    named = rows.withColumn("digest", F.sha2(text_of("`text`"), 256))
    times = mixing.taken(named, "doc_id", "digest").groupBy("doc_id", "digest").agg(
        F.floor(F.avg("taken") / F.greatest(F.first("size"), F.lit(1)) + 0.5).cast("int").alias("times"),
        F.min("first_place").alias("first"), F.min("second_place").alias("second"),
    )
    places = F.slice(F.array("first", F.coalesce("second", "first")), 1, F.col("times"))
    times = times.where("times > 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), places.alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    copies = named.select(*numbered, "doc_id", "digest").join(times, same).withColumn("place", F.explode("places"))
    order = ["place", "doc_id", "digest"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*numbered).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document (copies apart) with its sequence and place. A null text is the empty document: one piece."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
