"""End-to-end corpus builds: texts to documents, chunks, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.operators import chunking, graph
from lexgrove.operators.merge import last_by
from lexgrove.operators.sequences import next_edges, with_position


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    chunks: DataFrame
    next_edges: DataFrame
    typed_edges: DataFrame | None = None
    rows_read: int | None = None  # chunk rows that were made
    rows_kept: int | None = None  # of these, one per chunk id


def legal_corpus(docs: DataFrame, parity: bool = False) -> Corpus:
    """Statute texts ``(filename, text)`` to document, chunk and edge tables."""
    rows = chunking.statute_chunks(docs, parity)
    documents = graph.legal_documents(rows)
    chunks = graph.part_of(rows, documents, "doc_id", "chunk_id", graph.LEGAL_CHUNK_FIELDS)
    return Corpus(
        documents,
        with_position(chunks, "doc_id", "chunk_index"),
        next_edges(chunks, "doc_id", "chunk_index", "chunk_id"),
    )


def verdict_corpus(docs: DataFrame, parity: bool = False) -> Corpus:
    """Verdict texts ``(filename, text)`` to verdict, chunk and edge tables."""
    rows = chunking.verdict_chunks(docs, parity)
    verdicts = graph.verdicts(rows)
    chunks = graph.part_of(rows, verdicts, "verdict_id", "vchunk_id", graph.VERDICT_CHUNK_FIELDS)
    return Corpus(
        verdicts,
        with_position(chunks, "verdict_id", "chunk_index"),
        next_edges(chunks, "verdict_id", "chunk_index", "vchunk_id"),
        graph.typed_edges(chunks, "vchunk_id", "verdict_id", "section_type", fv.SECTION_RELATIONS),
    )


def _stored(rows: DataFrame, folder: str, chunk_id: str) -> tuple[DataFrame, int, int]:
    """Chunk rows, the last of each id, written once to ``folder`` and read again.

    Rows made and rows kept are counted in the same pass: their difference is the number of
    rows that broke the uniqueness of the id. (A task that is run again may count twice.)
    """
    read, kept = Observation(), Observation()
    counted = rows.observe(read, F.count(F.lit(1)).alias("rows"))
    latest = last_by(counted, [chunk_id], ["filename", "chunk_index"])
    latest.observe(kept, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder), read.get["rows"], kept.get["rows"]


def stored_legal_corpus(docs: DataFrame, folder: str, parity: bool = False) -> Corpus:
    """``legal_corpus`` with the chunker run once: all tables are read from the chunk rows in ``folder``."""
    rows, read, kept = _stored(chunking.statute_chunks(docs, parity), folder, "chunk_id")
    chunks = rows.select(*graph.LEGAL_CHUNK_FIELDS)
    return Corpus(
        graph.legal_documents(rows), with_position(chunks, "doc_id", "chunk_index"),
        next_edges(chunks, "doc_id", "chunk_index", "chunk_id"), None, read, kept,
    )


def stored_verdict_corpus(docs: DataFrame, folder: str, parity: bool = False, size: int = fv.CHUNK_SIZE) -> Corpus:
    """``verdict_corpus`` with the chunker run once: all tables are read from the chunk rows in ``folder``."""
    rows, read, kept = _stored(chunking.verdict_chunks(docs, parity, size), folder, "vchunk_id")
    chunks = rows.select(*graph.VERDICT_CHUNK_FIELDS)
    return Corpus(
        graph.verdicts(rows), with_position(chunks, "verdict_id", "chunk_index"),
        next_edges(chunks, "verdict_id", "chunk_index", "vchunk_id"),
        graph.typed_edges(chunks, "vchunk_id", "verdict_id", "section_type", fv.SECTION_RELATIONS), read, kept,
    )


def points(chunks: DataFrame, encoded: DataFrame, key: str) -> DataFrame:
    """Vector rows: chunk columns with the vector of the same key."""
    return chunks.join(encoded.select(key, F.col("vector")), key)
