"""Name search of many names against a register: contains tier, trigram tier, merge.

Neither tier compares every query with every name. Both go through an equi-join
on character grams, and the expensive tests run only on pairs that share one:

* contains: a name can contain a query only if it holds the query's rarest
  trigram (or shorter gram), so that gram alone is the join key;
* similarity: sets whose Jaccard score exceeds ``t`` must share one of their
  ``n - floor(t*n)`` rarest trigrams. A pair is kept only at its first common
  gram, so it is produced once and no ``distinct`` is needed. A high threshold
  needs only the rarest grams and is tried first on large registers; a query that
  then has enough names is finished, since every other name scores lower.

A checked number of queries takes a shorter way: they are broadcast (for
similarity as an inverted list of their grams), and each task tests its share of
the names and keeps the best names per query; one scan, nothing exploded, only
results are shuffled. Above the limit the gram joins give the same rows.

Work is done on distinct names; copies are expanded after the top-k cut. Grams
held by very many names are split into parts, which the query side visits all.
``register`` has ``key`` and ``name`` (and ``classes`` for the class filter);
``queries`` has ``query_id`` and ``name``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.trigrams import plain_grams, similarity, trigrams
from lexgrove.operators.sizes import if_small
from lexgrove.session import ship_package

GRAM_PART_ROWS = 50_000
SCAN_QUERIES = 2_000
BROADCAST_GRAMS = 2_000_000  # grams of all queries together
_WAITING_ROWS = 2_000_000  # found names that wait to be merged
_SCORE_TILE = 4_000_000  # scores held at once by a task
FIRST_THRESHOLD = 0.4
SALTS = 16
LADDER_ROWS = 1_000_000  # registers above this size try the high threshold first


def _parts(names_with_gram: Column, part_rows: int) -> Column:
    return F.greatest(F.ceil(names_with_gram / F.lit(part_rows)), F.lit(1)).cast("int")


def _visit_all_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop(
        "_parts"
    )


def _one_part(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop(
        "_parts"
    )


def _per_salt(facts: DataFrame) -> DataFrame:
    """A small table with one row per gram, repeated for every salt."""
    return facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_salt(postings: DataFrame, by: str) -> DataFrame:
    """Spreads the rows of one gram over the salts, so no join task gets them all."""
    return postings.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _expanded(
    best_names: DataFrame, register: DataFrame, order: list[Column], limit: int, queries: int
) -> DataFrame:
    """Register rows of the chosen names, cut to ``limit`` per query again.

    There are at most ``queries * limit`` chosen names. Only their rows are kept of the
    register, and of these at most ``limit`` copies of a name, in key order: later ones can
    never be used. So a name with very many copies is not repeated for every query that chose it.
    """
    most = queries * limit
    of_name = Window.partitionBy("name").orderBy("key")
    register = (
        register.join(if_small(best_names.select("name").distinct(), most), "name", "left_semi")
        .withColumn("_copy", F.row_number().over(of_name))
        .where(F.col("_copy") <= limit)
        .drop("_copy")
    )
    chosen = if_small(best_names, most)
    of_query = Window.partitionBy("query_id").orderBy(*order, "name", "key")
    return (
        register.join(chosen, "name")
        .withColumn("rank", F.row_number().over(of_query))
        .where(F.col("rank") <= limit)
    )


def _cut_names(found: DataFrame, order: Column, limit: int) -> DataFrame:
    """Best ``limit`` names per query, ties by name."""
    by_name = Window.partitionBy("query_id").orderBy(order, "name")
    return (
        found.withColumn("_r", F.row_number().over(by_name)).where(F.col("_r") <= limit).drop("_r")
    )


def contains_tier(
    queries: DataFrame,
    register: DataFrame,
    limit: int = fv.NAME_LIMIT,
    wildcards: bool = False,
    part_rows: int = GRAM_PART_ROWS,
    scan_queries: int = SCAN_QUERIES,
) -> DataFrame:
    """Names that contain the query, equal names first, then by name and key.

    With ``wildcards`` the characters ``%`` and ``_`` of a query act as in LIKE; a backslash is only itself.
    Blank queries match nothing, or every name with ``wildcards``. Up to
    ``scan_queries`` queries are answered by one scan, more by the gram join.
    """
    asked = queries.where(F.col("name").isNotNull()).select(
        "query_id", F.lower("name").alias("_query")
    )
    if not wildcards:
        asked = asked.where(F.col("_query") != "")
    n = asked.count()
    not_equal = (~F.col("_equal")).cast("int")
    if n <= scan_queries:
        found = _scan_containing(
            asked.toArrow(), register, limit, wildcards, _found_schema(queries)
        ).distinct()
        found = found.select("query_id", "name", (F.col("loss") == 0).alias("_equal"))
    else:
        found = _joined_containing(asked, register, wildcards, part_rows)
    best = _cut_names(found, not_equal, limit)
    rows = _expanded(best, register, [not_equal], limit, n)
    score = F.when(F.col("_equal"), fv.NAME_EXACT_SCORE).otherwise(fv.NAME_CONTAINS_SCORE)
    return rows.withColumns({"score": score, "match_type": F.lit("exact")}).drop("_equal")


def _joined_containing(
    asked: DataFrame, register: DataFrame, wildcards: bool, part_rows: int
) -> DataFrame:
    """``(query_id, name, _equal)`` of all containing names, by the rarest gram."""
    fragments = (
        F.split("_query", "[%_]+") if wildcards else F.array(F.col("_query"))
    )

    def grams_of(text: Column) -> Column:
        """Grams of the longest length the text has, up to three."""
        return (
            F.when(F.length(text) >= 3, plain_grams(text, 3))
            .when(F.length(text) >= 1, F.array(text))
            .otherwise(F.array().cast("array<string>"))
        )

    query_grams = F.flatten(F.transform(fragments, grams_of))
    if wildcards:
        query_grams = F.when(F.size(query_grams) == 0, F.array(F.lit(""))).otherwise(query_grams)
    asked = asked.withColumn("_gram", F.explode(query_grams))

    names = register.select("name", F.lower("name").alias("_lower")).distinct()
    all_grams = F.concat(
        plain_grams(F.col("_lower"), 1),
        plain_grams(F.col("_lower"), 2),
        plain_grams(F.col("_lower"), 3),
        *([F.array(F.lit(""))] if wildcards else []),
    )
    # outer: else a non-empty test of the grams is pushed below the distinct
    postings = _with_salt(names.withColumn("_gram", F.explode_outer(all_grams)), "name")
    # only grams some query asks for are counted and kept
    wanted = _per_salt(asked.select("_gram").distinct())
    held = postings.join(wanted, ["_gram", "_salt"], "left_semi")
    counts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_names"))
    # a query with a gram that no name holds has no match
    keys = (
        asked.join(counts, "_gram", "left")
        .groupBy("query_id", "_query")
        .agg(
            F.min_by(F.struct("_gram", "_names"), F.struct(F.coalesce("_names", F.lit(0)), "_gram"))
            .alias("_rarest")
        )
        .where(F.col("_rarest._names").isNotNull())
        .select(
            "query_id",
            "_query",
            F.col("_rarest._gram").alias("_gram"),
            _parts(F.col("_rarest._names"), part_rows).alias("_parts"),
        )
    )
    used = _per_salt(keys.select("_gram", "_parts").distinct())
    chosen = held.join(used, ["_gram", "_salt"]).drop("_salt")
    return (
        _visit_all_parts(keys)
        .join(_one_part(chosen, "name"), ["_gram", "_part"])
        .where(
            F.like("_lower", F.concat(F.lit("%"), F.replace("_query", F.lit("\\"), F.lit("\\\\")), F.lit("%")))
            if wildcards
            else F.contains("_lower", "_query")
        )
        .select("query_id", "name", (F.col("_lower") == F.col("_query")).alias("_equal"))
    )


def _ordered_grams(names: DataFrame, id_cols: list[str], counts: DataFrame, t: float) -> DataFrame:
    """Add ``_prefix``: the rarest grams of each set that decide about a match."""
    grams = names.select(*id_cols, F.explode_outer("_grams").alias("_gram")).where(
        F.col("_gram").isNotNull()
    )
    salted = _with_salt(grams, id_cols[0])
    ranked = salted.join(_per_salt(counts), ["_gram", "_salt"], "left").select(
        *id_cols,
        F.struct(
            F.coalesce("_names", F.lit(0)).alias("names"), F.col("_gram").alias("gram")
        ).alias("_token"),
    )
    # one name's grams: bounded by its length
    ordered = ranked.groupBy(*id_cols).agg(F.array_sort(F.collect_list("_token")).alias("_ordered"))
    n = F.size("_ordered")
    return ordered.withColumn(
        "_prefix", F.slice("_ordered", F.lit(1), n - F.floor(n * F.lit(t)).cast("int"))
    )


def similar_pairs(
    queries: DataFrame,
    register: DataFrame,
    threshold: float = fv.NAME_SIMILARITY_THRESHOLD,
    part_rows: int = GRAM_PART_ROWS,
) -> DataFrame:
    """``(query_id, lower_name, similarity)`` of all pairs above the threshold."""
    asked = queries.select("query_id", F.lower("name").alias("_q"))
    texts = asked.select("_q").distinct().withColumn("_grams", trigrams(F.col("_q")))
    names = (
        register.select(F.lower("name").alias("lower_name"))
        .distinct()
        .withColumn("_grams", trigrams(F.col("lower_name")))
    )
    counts = (
        names.select(F.explode_outer("_grams").alias("_gram"))
        .groupBy("_gram")
        .agg(F.count(F.lit(1)).alias("_names"))
    )
    left = _ordered_grams(texts, ["_q"], counts, threshold).select(
        "_q",
        F.col("_ordered.gram").alias("_qgrams"),
        F.col("_prefix.gram").alias("_qprefix"),
        F.explode("_prefix").alias("_t"),
    )
    right = _ordered_grams(names, ["lower_name"], counts, threshold).select(
        "lower_name",
        F.col("_ordered.gram").alias("_ngrams"),
        F.col("_prefix.gram").alias("_nprefix"),
        F.explode("_prefix").alias("_t"),
    )

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"_gram": F.col("_t.gram"), "_parts": _parts(F.col("_t.names"), part_rows)}
        ).drop("_t")

    pairs = _visit_all_parts(keyed(left)).join(
        _one_part(keyed(right), "lower_name"), ["_gram", "_part"]
    )
    first_common = F.get(F.array_intersect("_qprefix", "_nprefix"), F.lit(0))
    score = similarity(
        F.size(F.array_intersect("_qgrams", "_ngrams")), F.size("_qgrams"), F.size("_ngrams")
    )
    scored = (
        pairs.where(F.col("_gram") == first_common)
        .select("_q", "lower_name", score.alias("similarity"))
        .where(F.col("similarity") > threshold)
    )
    return asked.join(scored, "_q").select("query_id", "lower_name", "similarity")


class _QueryGrams:
    """Grams of all queries as an inverted list: gram number to query numbers."""

    def __init__(self, table: pa.Table):
        self.ids = table["query_id"].combine_chunks()
        lists = table["grams"].combine_chunks()
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        self.vocabulary = flat.unique()
        gram = pc.index_in(flat, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(gram, kind="stable")
        self.owners = owner[order]
        self.starts = np.searchsorted(gram[order], np.arange(len(self.vocabulary) + 1))

    def similarities(self, lists: pa.ListArray) -> np.ndarray:
        """Jaccard score of every name (row) with every query (column)."""
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        gram = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1)
        gram = gram.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)[gram >= 0]
        gram = gram[gram >= 0]
        hits = self.starts[gram + 1] - self.starts[gram]
        # positions in the inverted list: start of the gram plus 0, 1, 2, ...
        place = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        query = self.owners[np.repeat(self.starts[gram], hits) + place]
        n = len(self.ids)
        shared = np.bincount(np.repeat(row, hits) * n + query, minlength=len(sizes) * n)
        shared = shared.reshape(len(sizes), n)
        union = sizes[:, None] + self.sizes[None, :] - shared
        return shared / np.maximum(union, 1)


def _best_names(found: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Best distinct names per query: lowest loss, then name."""
    query, loss = found["query"].to_numpy(), found["loss"].to_numpy()
    code = pd.factorize(found["name"], sort=True)[0]
    order = np.lexsort((code, loss, query))
    query, loss, code = query[order], loss[order], code[order]
    # a name has one loss for a query, so copies stand side by side
    new = np.ones(len(order), bool)
    new[1:] = (query[1:] != query[:-1]) | (code[1:] != code[:-1])
    order, query = order[new], query[new]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return found.iloc[order[place < limit]]


def _running_best(
    batches: Iterator[pa.RecordBatch], ids: pa.Array, limit: int, find
) -> Iterator[pa.RecordBatch]:
    """Best names per query over all batches of a task; ``find`` scores a slice.

    What a slice finds waits until there is enough of it to be merged; once a query has
    ``limit`` names, anything worse than its last one is left out at once.
    """
    best = pd.DataFrame({"query": np.zeros(0, np.int64), "name": np.zeros(0, object), "loss": np.zeros(0)})
    worst = np.full(len(ids), np.inf)
    waiting, rows = [], 0
    tile = max(1, _SCORE_TILE // max(1, len(ids)))

    def merged() -> pd.DataFrame:
        kept = _best_names(pd.concat([best, *waiting]), limit)
        query = kept["query"].to_numpy()
        full = np.bincount(query, minlength=len(ids)) >= limit
        last = np.full(len(ids), -np.inf)
        np.maximum.at(last, query, kept["loss"].to_numpy())
        worst[full] = last[full]
        return kept

    for batch in batches:
        fresh = ~pd.Series(batch.column("name").to_pandas()).duplicated().to_numpy()
        batch = batch.filter(pa.array(fresh))
        for start in range(0, batch.num_rows, tile):
            part = batch.slice(start, tile)
            row, query, loss = find(part)
            useful = loss <= worst[query]
            row, query, loss = row[useful], query[useful], loss[useful]
            names = np.asarray(part.column("name").to_pandas(), object)[row]
            waiting.append(pd.DataFrame({"query": query, "name": names, "loss": loss}))
            rows += len(row)
            if rows > _WAITING_ROWS:
                best, waiting, rows = merged(), [], 0
    if waiting:
        best = merged()
    if len(best):
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(best["query"].to_numpy())),
                pa.array(best["name"].to_numpy(), pa.string()),
                pa.array(best["loss"].to_numpy(), pa.float64()),
            ],
            names=["query_id", "name", "loss"],
        )


def _found_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("name", T.StringType()),
            T.StructField("loss", T.DoubleType()),
        ]
    )


def _scan_similar(
    grams: pa.Table, register: DataFrame, limit: int, threshold: float, schema: T.StructType
) -> DataFrame:
    """``(query_id, name, loss)``, the loss being the negative similarity."""
    ship_package(register.sparkSession)
    shared = register.sparkSession.sparkContext.broadcast(_QueryGrams(grams))

    def best_of_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value

        def find(part: pa.RecordBatch):
            scores = queries.similarities(part.column("grams"))
            # a name below the best ``limit`` scores of this slice cannot be a result
            keep = min(limit, scores.shape[0])
            floor = -np.partition(-scores, keep - 1, axis=0)[keep - 1]
            row, query = np.nonzero((scores > threshold) & (scores >= floor))
            return row, query, -scores[row, query]

        return _running_best(batches, queries.ids, limit, find)

    names = register.where(F.col("name").isNotNull()).select(
        "name", trigrams(F.col("name")).alias("grams")
    )
    return names.mapInArrow(best_of_share, schema)


def _like(text: str) -> str:
    """Pattern of a query in which ``%`` and ``_`` are the only signs."""
    signs = {"%": ".*", "_": "."} | {c: "\\" + c for c in r"\.^$|?*+()[]{}"}
    return "(?s)" + "".join(signs.get(c, c) for c in text)


def _scan_containing(
    asked: pa.Table, register: DataFrame, limit: int, wildcards: bool, schema: T.StructType
) -> DataFrame:
    """``(query_id, name, loss)``, the loss being 0 for equal names, else 1."""
    ids = asked["query_id"].combine_chunks()
    ship_package(register.sparkSession)
    shared = register.sparkSession.sparkContext.broadcast((ids, asked["_query"].to_pylist()))

    def best_of_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, texts = shared.value

        def find(part: pa.RecordBatch):
            lower = part.column("_lower")
            rows, owners, losses = [], [], []
            for number, text in enumerate(texts):
                hit = (
                    pc.match_substring_regex(lower, _like(text))
                    if wildcards
                    else pc.match_substring(lower, text)
                )
                at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
                equal = pc.equal(lower.take(pa.array(at)), text).to_numpy(zero_copy_only=False)
                rows.append(at)
                owners.append(np.full(len(at), number))
                losses.append(np.where(equal, 0.0, 1.0))
            return np.concatenate(rows), np.concatenate(owners), np.concatenate(losses)

        return _running_best(batches, qids, limit, find) if texts else iter(())

    names = register.where(F.col("name").isNotNull()).select("name", F.lower("name").alias("_lower"))
    return names.mapInArrow(best_of_share, schema)


def fuzzy_tier(
    queries: DataFrame,
    register: DataFrame,
    limit: int = fv.NAME_LIMIT,
    threshold: float = fv.NAME_SIMILARITY_THRESHOLD,
    part_rows: int = GRAM_PART_ROWS,
    first_threshold: float = FIRST_THRESHOLD,
    ladder_rows: int = LADDER_ROWS,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """Most similar names by trigrams; ties by name and key; scores are capped.

    Queries with up to ``broadcast_grams`` grams are answered by one scan. More of
    them go through the gram join, above ``ladder_rows`` register rows with
    ``first_threshold`` tried first. All ways give the same rows.
    """

    def cut(found: DataFrame) -> DataFrame:
        return _cut_names(found, F.col("similarity").desc(), limit)

    asked = queries.where(F.col("name").isNotNull()).select("query_id", "name")
    coded = asked.select("query_id", trigrams(F.col("name")).alias("grams"))
    size = coded.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("grams")
    ).first()
    if size["grams"] <= broadcast_grams:
        partial = _scan_similar(
            coded.toArrow(), register, limit, threshold, _found_schema(queries)
        )
        best = cut(partial.distinct().withColumn("similarity", -F.col("loss")).drop("loss"))
    else:
        best = _joined_best(
            asked, register, limit, threshold, part_rows, first_threshold, ladder_rows, cut
        )
    rows = _expanded(best, register, [F.col("similarity").desc()], limit, size["n"])
    score = F.round(F.least(F.col("similarity"), F.lit(fv.NAME_FUZZY_CAP)), 4)
    return rows.withColumns({"score": score, "match_type": F.lit("fuzzy")}).drop("similarity")


def _joined_best(
    asked, register, limit, threshold, part_rows, first_threshold, ladder_rows, cut
) -> DataFrame:
    """Best names per query by the gram join, with the threshold ladder."""
    spelled = register.select("name", F.lower("name").alias("lower_name")).distinct()

    def best_above(some: DataFrame, t: float) -> DataFrame:
        pairs = similar_pairs(some, register, t, part_rows).join(spelled, "lower_name")
        return cut(pairs.drop("lower_name"))

    if first_threshold <= threshold or register.count() <= ladder_rows:
        return best_above(asked, threshold)
    high = best_above(asked, first_threshold)
    enough = (
        high.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= limit)
        .select("query_id")
    )
    rest = best_above(asked.join(enough, "query_id", "left_anti"), threshold)
    return high.join(enough, "query_id", "left_semi").unionByName(rest.select(*high.columns))


def class_filter(hits: DataFrame, wanted: Column, classes: str = "classes") -> DataFrame:
    """Keep rows without classes or with one of the wanted; no wanted, no filter."""
    have = F.coalesce(F.col(classes), F.array().cast("array<string>"))
    none_wanted = wanted.isNull() | (F.size(wanted) == 0)
    return hits.where(none_wanted | (F.size(have) == 0) | F.arrays_overlap(have, wanted))


def merge_tiers(tiers: list[DataFrame]) -> DataFrame:
    """One row per query and key: highest score, the earlier tier on a tie.

    ``position`` orders the result: by score, then by where a key first appeared.
    Rows without a key are dropped. Every tier is already cut to its limit, so a
    query has only a few rows here.
    """
    placed = [
        t.where(F.coalesce(F.col("key").cast("string"), F.lit("")) != "").withColumn(
            "_place", F.struct(F.lit(i).alias("tier"), F.col("rank").alias("rank"))
        )
        for i, t in enumerate(tiers)
    ]
    rows = placed[0]
    for other in placed[1:]:
        rows = rows.unionByName(other)
    of_key = Window.partitionBy("query_id", "key")
    first = rows.withColumn("_first", F.min("_place").over(of_key)).withColumn(
        "_best",
        F.row_number().over(of_key.orderBy(F.col("score").desc(), F.col("_place"))),
    )
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_first")
    return (
        first.where(F.col("_best") == 1)
        .withColumn("position", F.row_number().over(by_score))
        .drop("_place", "_first", "_best", "rank")
    )


def search(
    queries: DataFrame,
    register: DataFrame,
    limit: int = fv.NAME_LIMIT,
    only_classes: list[str] | None = None,
    wildcards: bool = False,
    part_rows: int = GRAM_PART_ROWS,
) -> DataFrame:
    """Both tiers, merged, class-filtered and cut: ``rank`` 1..limit per query.

    ``queries`` may carry ``classes`` (wanted classes). The tiers are cut before
    this filter, so fewer than ``limit`` rows may remain. ``only_classes``, one
    list for all queries, filters the register before the search instead.
    """
    if only_classes:
        register = class_filter(register, F.array(*[F.lit(c) for c in only_classes]))
    tiers = [
        contains_tier(queries, register, limit, wildcards, part_rows),
        fuzzy_tier(queries, register, limit, part_rows=part_rows),
    ]
    merged = merge_tiers(tiers)
    if "classes" in queries.columns:
        wanted = queries.select("query_id", F.col("classes").alias("_wanted"))
        merged = class_filter(merged.join(wanted, "query_id"), F.col("_wanted")).drop("_wanted")
    final = Window.partitionBy("query_id").orderBy("position")
    return (
        merged.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= limit)
        .drop("position")
    )
