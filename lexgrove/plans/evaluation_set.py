"""Generated evaluation set: one question per document article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.corpus_ids import corpus_id
from lexgrove.functions.text import any_contains, collapse_blanks, fill, snippet
from lexgrove.operators.merge import first_by
from lexgrove.operators.retrieval import valid_at
from lexgrove.operators.sampling import seeded_digest, seeded_sample

FIELDS = ["dieu", "dieu_title", "doc_name", "doc_number", "content"]


def question_templates() -> Column:
    """Array of the questions that the known fields of a row allow."""
    clean = {c: collapse_blanks(F.col(c)) for c in FIELDS}
    known = {c: clean[c] != "" for c in FIELDS}
    needs = {
        "title_how": known["dieu_title"],
        "title_what": known["dieu_title"],
        "article_in": known["dieu"] & known["doc_name"],
        "article_of": known["dieu"] & known["doc_name"],
        "article_number": known["dieu"] & known["doc_number"],
        "content": known["content"],
    }
    values = {**clean, "snippet": snippet(F.col("content"), fv.SNIPPET_CHARS)}
    return F.array_compact(
        F.array(
            *[
                F.when(needs[name], fill(template, **values))
                for name, template in fv.QUESTION_TEMPLATES.items()
            ]
        )
    )


def choose_question(templates: Column, style: str, id_col: Column, seed: int) -> Column:
    """``title`` and ``article`` take the first fitting question, else the first;
    ``mixed`` draws one by a seeded digest of the id."""
    if style in fv.QUESTION_STYLE_WORDS:
        words = fv.QUESTION_STYLE_WORDS[style]
        fitting = F.filter(templates, lambda t: any_contains(t, words))
        return F.coalesce(F.get(fitting, F.lit(0)), F.get(templates, F.lit(0)))
    draw = F.conv(F.substring(seeded_digest(id_col, seed), 1, 8), 16, 10).cast("long")
    return F.get(templates, F.pmod(draw, F.greatest(F.size(templates), F.lit(1))).cast("int"))


def active_ids(chunks: DataFrame, documents: DataFrame, day: str) -> DataFrame:
    """Corpus ids of articles whose document is in force."""
    valid = valid_at(documents, day).select("doc_id", "doc_number")
    ids = chunks.join(valid, "doc_id").select(corpus_id(F.col("doc_number"), F.col("dieu")).alias("corpus_id"))
    return ids.where(F.col("corpus_id").isNotNull()).distinct()


def build(
    payloads: DataFrame,
    order: list[str],
    max_queries: int = 1000,
    style: str = "mixed",
    seed: int = 42,
    active: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, query_text, corpus_id)`` rows and the one-row counters.

    Ids are numbered before questions without text are left out, so numbers may
    have gaps.
    """
    ids = payloads.withColumn("corpus_id", corpus_id(F.col("doc_number"), F.col("dieu")))
    flagged = ids.withColumn("_invalid", F.col("corpus_id").isNull())
    if active is None:
        flagged = flagged.withColumn("_inactive", F.lit(False))
    else:
        mark = active.select("corpus_id", F.lit(True).alias("_active"))
        flagged = flagged.join(mark, "corpus_id", "left").withColumn(
            "_inactive", ~F.col("_invalid") & F.col("_active").isNull()
        )
    usable = flagged.where(~F.col("_invalid") & ~F.col("_inactive"))
    unique = first_by(usable.select("corpus_id", *FIELDS, *order), ["corpus_id"], order)
    chosen = seeded_sample(unique, "corpus_id", seed, max_queries)
    question = choose_question(F.col("_templates"), style, F.col("corpus_id"), seed)
    rows = (
        chosen.withColumn("_templates", question_templates())
        .select(
            F.format_string("int_%06d", "position").alias("query_id"),
            question.alias("query_text"),
            "corpus_id",
        )
        .where(F.coalesce("query_text", F.lit("")) != "")
    )
    counters = flagged.agg(
        F.count(F.lit(1)).alias("total_points_scanned"),
        F.count_if("_invalid").alias("payloads_missing_doc_or_dieu"),
        F.count_if("_inactive").alias("payloads_filtered_inactive"),
    ).withColumn("queries_generated", rows.agg(F.count(F.lit(1))).scalar())
    return rows, counters
