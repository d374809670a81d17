"""Document and chunk tables with their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import corpus_ids
from lexgrove.functions import fixed_values as fv
from lexgrove.operators.merge import first_by, last_by

LEGAL_DOC_FIELDS = [
    "doc_name", "doc_type", "doc_number", "issuing_agency", "signing_date", "effective_date",
    "status",
]
LEGAL_CHUNK_FIELDS = [
    "chunk_id", "doc_id", "content", "chunk_index", "chunk_type", "phan", "chuong",
    "chuong_title", "muc", "dieu", "dieu_title", "is_continuation",
]
VERDICT_FIELDS = [
    "case_number", "court_name", "judgment_date", "dispute_type", "trial_level", "plaintiff",
    "defendant", "third_party", "ip_types", "judges", "law_references", "summary",
]
VERDICT_CHUNK_FIELDS = [
    "vchunk_id", "verdict_id", "content", "chunk_index", "section_type", "party_role",
    "point_number", "item_number",
]


def dimension_of(
    chunks: DataFrame, file_col: str, index_col: str, key: str, fields: list[str]
) -> DataFrame:
    """One row per ``key``: the first chunk of a file describes it, the last file wins."""
    per_file = first_by(
        chunks.select(file_col, index_col, key, *fields), [file_col], [index_col]
    ).drop(index_col)
    return last_by(per_file, [key], [file_col])


def legal_documents(chunks: DataFrame) -> DataFrame:
    return dimension_of(chunks, "filename", "chunk_index", "doc_id", LEGAL_DOC_FIELDS)


def verdicts(chunks: DataFrame) -> DataFrame:
    dim = dimension_of(chunks, "filename", "chunk_index", "verdict_id", VERDICT_FIELDS)
    return dim.withColumns(
        {
            "ip_types_str": F.array_join("ip_types", ","),
            "law_references_str": F.array_join(
                F.slice("law_references", 1, fv.LAW_REFERENCES_JOINED), "|"
            ),
        }
    )


def part_of(
    chunks: DataFrame, documents: DataFrame, key: str, chunk_id: str, fields: list[str]
) -> DataFrame:
    """Chunk table: last row per chunk id; only chunks whose document exists."""
    latest = last_by(
        chunks.select("filename", *fields), [chunk_id], ["filename", "chunk_index"]
    ).drop("filename")
    return latest.join(documents.select(key), key, "left_semi").select(*fields)


def typed_edges(
    chunks: DataFrame, src: str, dst: str, section: str, relations: list[tuple[str, str]]
) -> DataFrame:
    """``(src, dst, rel_type)`` by the section of a chunk; other sections have none."""
    names = F.create_map(*[F.lit(x) for pair in relations for x in pair])
    return (
        chunks.select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), names[F.col(section)].alias("rel_type")
        )
        .where(F.col("rel_type").isNotNull())
        .distinct()
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that break uniqueness: empty if the key is sound."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def evaluation_rows(corpus: DataFrame) -> DataFrame:
    """Benchmark corpus ``(_id, title, text)`` as chunk rows with article fields."""
    parsed = corpus_ids.parse_corpus_id(F.col("_id"), F.col("title"))
    return corpus.select(
        F.col("_id").alias("chunk_id"),
        *[c.alias(n) for n, c in parsed.items()],
        F.coalesce("text", F.lit("")).alias("content"),
        parsed["doc_number"].alias("doc_name"),
        F.lit(fv.DEFAULT_DOC_TYPE).alias("doc_type"),
    )


def evaluation_documents(rows: DataFrame, source: str) -> DataFrame:
    """Distinct documents of the evaluation corpus; the first row by id describes one."""
    doc = rows.select(F.col("doc_number").alias("doc_id"), "doc_number", "doc_name", "doc_type", "chunk_id")
    return first_by(doc, ["doc_id"], ["chunk_id"]).drop("chunk_id").withColumns(
        {
            "status": F.lit("active"),
            "effective_date": F.lit(None).cast("string"),
            "source": F.lit(source),
        }
    )


def evaluation_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the evaluation corpus, ordered inside a document by article.

    Only the order inside a document is ever used, so the index is made from the
    article number and its letter, without numbering the whole corpus.
    """
    number = F.regexp_extract("dieu", r"(\d+)", 1).try_cast("int")
    letter = F.regexp_extract("dieu", r"\d+([a-z])", 1)
    index = F.coalesce(number, F.lit(0)) * 32 + F.when(letter != "", F.ascii(letter) - 96).otherwise(0)
    return rows.select(
        "chunk_id",
        F.col("doc_number").alias("doc_id"),
        "content",
        index.alias("chunk_index"),
        F.lit("content").alias("chunk_type"),
        "dieu",
        "dieu_title",
    )
