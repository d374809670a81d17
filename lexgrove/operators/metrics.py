"""Retrieval quality: precision@k, recall@k, reciprocal rank, means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.operators.sizes import if_small


def dedupe_ranked(hits: DataFrame, item: str = "id") -> DataFrame:
    """First occurrence of every item of a query, ranked again without gaps."""
    first = hits.groupBy("query_id", item).agg(F.min("rank").alias("_rank"))
    order = Window.partitionBy("query_id").orderBy("_rank")
    return first.withColumn("rank", F.row_number().over(order)).drop("_rank")


def evaluation_queries(qrels: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Judged queries with a known, non-empty text; optionally the first ones by id."""
    known = queries.where(F.coalesce(F.col("text"), F.lit("")) != "")
    found = known.join(qrels.select("query_id"), "query_id", "left_semi")
    return found if limit is None else found.orderBy("query_id").limit(limit)


def per_query_metrics(
    judged: DataFrame, totals: DataFrame, ks: Sequence[int] = fv.EVAL_KS
) -> DataFrame:
    """``(query_id, k, precision, recall, reciprocal_rank)`` for every query of ``totals``.

    ``judged(query_id, rank, relevant)`` holds the ranked hits with a flag,
    ``totals(query_id, n_relevant)`` every evaluated query. The metrics of all
    cut-offs come from one grouped aggregate.
    """
    found = judged.groupBy("query_id").agg(
        *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"_at{k}") for k in ks],
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
    )
    rows = totals.join(found, "query_id", "left")
    per_k = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"), F.coalesce(f"_at{k}", F.lit(0)).alias("found")
                )
                for k in ks
            ]
        )
    )
    share = F.when(F.col("n_relevant") > 0, F.col("m.found") / F.col("n_relevant")).otherwise(0.0)
    return rows.select("query_id", "n_relevant", "_first", per_k.alias("m")).select(
        "query_id",
        F.col("m.k").alias("k"),
        (F.col("m.found") / F.col("m.k")).alias("precision"),
        share.alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_metrics(per_query: DataFrame, ks: Sequence[int] = fv.EVAL_KS) -> DataFrame:
    """Means over queries per cut-off; 0 if there is no query."""
    def mean(value: str, k: int):
        return F.coalesce(F.avg(F.when(F.col("k") == k, F.col(value))), F.lit(0.0))

    rows = [
        F.struct(
            F.lit(int(k)).alias("k"),
            mean("precision", k).alias("precision"),
            mean("recall", k).alias("recall"),
            mean("reciprocal_rank", k).alias("mrr"),
            F.count_if(F.col("k") == k).alias("queries"),
        )
        for k in ks
    ]
    # one grouped row without keys: present even if there is no query
    return per_query.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select(
        "r.*"
    )


def looks_unmatched(means: DataFrame) -> DataFrame:
    """True if every metric is 0: the ids of hits and judgements do not fit."""
    return means.agg(
        F.every((F.col("precision") == 0) & (F.col("recall") == 0) & (F.col("mrr") == 0)).alias(
            "all_zero"
        )
    )


def evaluate(
    queries: DataFrame,
    qrels: DataFrame,
    hits: DataFrame,
    ks: Sequence[int] = fv.EVAL_KS,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(means, per-query metrics)`` of ranked hits ``(query_id, rank, id)``."""
    wanted = evaluation_queries(qrels, queries, limit).select("query_id")
    pairs = qrels.select("query_id", F.col("corpus_id").alias("id")).distinct()
    totals = wanted.join(
        pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")), "query_id"
    )
    judged = (
        dedupe_ranked(hits)
        .join(pairs.withColumn("relevant", F.lit(True)), ["query_id", "id"], "left")
        .withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    )
    per_query = per_query_metrics(judged, totals, ks)
    return mean_metrics(per_query, ks), per_query


def evaluate_by_label(
    queries: DataFrame, labels: DataFrame, hits: DataFrame, ks: Sequence[int] = fv.EVAL_KS, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``evaluate`` where a hit is relevant if it has the query's label: ``queries(query_id, text, label)``, ``labels(id, label)``.

    The relevant rows of a query are counted by label, so no table of all relevant pairs is made.
    """
    totals = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    known = queries.join(totals, "label")
    wanted = evaluation_queries(known.select("query_id"), known, limit).select("query_id", "label", "n_relevant")
    # hits of queries that are not evaluated go before they are sorted
    asked = hits.join(if_small(wanted.select("query_id"), limit), "query_id", "left_semi")
    judged = dedupe_ranked(asked).join(labels.withColumnRenamed("label", "_found"), "id").join(wanted, "query_id")
    per_query = per_query_metrics(judged.withColumn("relevant", F.col("label") == F.col("_found")), wanted.drop("label"), ks)
    return mean_metrics(per_query, ks), per_query


def as_record(per_query: DataFrame) -> DataFrame:
    """Map form: ``precision`` and ``recall`` by cut-off, and the reciprocal rank."""
    def by_k(value: str):
        # one entry per cut-off
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", value)))).alias(value)

    return per_query.groupBy("query_id").agg(
        by_k("precision"), by_k("recall"), F.max("reciprocal_rank").alias("mrr")
    )
