"""Approximate vector top-k by an inverted file.

Coarse centroids, fitted on a bounded sample, deal every vector to the list of its
nearest centroid; the index keeps, of every vector, its id, its list and a code of one
byte a dimension. A query probes the lists whose centroids lie nearest. Only ids and
codes meet the queries in a shuffle, lists that are too long in parts; the best few
candidates of each query by code are then scored exactly, from vectors that are fetched
for those candidates alone.

How many lists a query probes is measured, not guessed: sampled queries are answered
exactly, and the least number of lists is taken that holds ``RECALL`` of their true
neighbours. There is no other path, whatever the size: where vectors lie evenly in all
directions many lists have to be probed, and where they lie in groups a few do.

Rows without a vector take no part. Zero vectors score 0 against everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.operators.vectors import SCORE_DIGITS, _matrix, cosine, cosine_topk, ranked
from lexgrove.session import ship_package

SAMPLE_VECTORS = 16_384  # rows at most that centroids are fitted on
LISTS = 1024  # lists at most; the square root of the number of vectors below that
ROUNDS = 10
SAMPLE_QUERIES = 200
RECALL = 0.95  # share of the true neighbours in the probed lists, on sampled queries
CANDIDATES = 4  # candidates by code for every row of the result
PART_ROWS = 50_000  # codes, or queries, of one list that meet in one task


@dataclass
class Centroids:
    """Unit centroids (lists x width), and how many lists a query probes for ``k`` neighbours."""

    vectors: np.ndarray
    probes: int = 1


def _sampled(df: DataFrame, id_col: str, rows: int) -> pa.Table:
    """At most ``rows`` rows, those that come first in a hashed order of the ids."""
    return df.select(id_col, "vector").where(F.col("vector").isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows).toArrow()


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE_VECTORS, seed: int = 42) -> Centroids:
    """Spherical k-means over a sample of ``vectors(id, vector)``."""
    rows = _matrix(_sampled(vectors, "id", sample)["vector"])
    wanted = lists or round(max(1, vectors.count()) ** 0.5)
    found = rows[np.random.default_rng(seed).permutation(len(rows))[: min(wanted, LISTS)]].copy()
    for _ in range(ROUNDS if len(found) else 0):
        own = np.argmax(rows @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), found)
    return Centroids(found)


def _codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed bytes and the length of one step of every row."""
    step = np.abs(rows).max(axis=1, initial=0) / 127
    step[step == 0] = 1.0
    return np.rint(rows / step[:, None]).astype(np.int8), step


def index(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``id, list, code, step`` of every vector: a table to store and to search; no shuffle."""
    ship_package(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids.vectors)
    rows = vectors.select("id", "vector").where(F.col("vector").isNotNull())

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector"))
            codes, step = _codes(matrix)
            own = np.argmax(matrix @ shared.value.T, axis=1)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(own.astype(np.int32)), packed, pa.array(step)], names=["id", "list", "code", "step"]
            )

    schema = T.StructType([vectors.schema["id"], *T._parse_datatype_string("list int, code binary, step double").fields])
    return rows.mapInArrow(dealt, schema)


def _probed(queries: DataFrame, centroids: Centroids) -> DataFrame:
    """``query_id, list, unit``: every query once for each list it probes, with its unit vector in single precision."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids.vectors)
    probes = centroids.probes

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector"))
            order = np.argsort(-(matrix @ shared.value.T), axis=1, kind="stable")[:, :probes]
            who = np.repeat(np.arange(len(matrix)), order.shape[1])
            packed = pa.array([r.astype("<f4").tobytes() for r in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(who)), pa.array(order.ravel().astype(np.int32)), packed.take(pa.array(who))],
                names=["query_id", "list", "unit"],
            )

    schema = T.StructType([queries.schema["query_id"], *T._parse_datatype_string("list int, unit binary").fields])
    return queries.select("query_id", "vector").where(F.col("vector").isNotNull()).mapInArrow(near, schema)


def probes_needed(queries: DataFrame, vectors: DataFrame, centroids: Centroids, k: int, skip_self: bool = False, recall: float = RECALL) -> int:
    """Least number of lists that holds ``recall`` of the true ``k`` neighbours of sampled queries."""
    asked = _sampled(queries, "query_id", SAMPLE_QUERIES)
    if not asked.num_rows or not len(centroids.vectors):
        return 1
    sample = queries.sparkSession.createDataFrame(asked, queries.select("query_id", "vector").schema)
    near = cosine_topk(sample, vectors, k, skip_self).select("query_id", "id")
    pairs = near.join(vectors.select("id", F.col("vector").alias("near")), "id").join(sample, "query_id").select("vector", "near").toArrow()
    if not pairs.num_rows:
        return 1
    own = np.argmax(_matrix(pairs["near"]) @ centroids.vectors.T, axis=1)
    scores = _matrix(pairs["vector"]) @ centroids.vectors.T
    place = (scores > scores[np.arange(len(own)), own][:, None]).sum(axis=1) + 1
    held = np.cumsum(np.bincount(place, minlength=len(centroids.vectors) + 1)) / len(place)
    return max(1, int(np.argmax(held >= recall)))


def _parts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).cast("int").alias(name))


def search(
    queries: DataFrame, vectors: DataFrame, indexed: DataFrame, centroids: Centroids, k: int,
    skip_self: bool = False, candidates: int = CANDIDATES,
) -> DataFrame:
    """``query_id, rank, id, score``: about the best ``k`` vectors of every query, scores exact.

    ``indexed`` is the table of ``index``; ``vectors(id, vector)`` serves to score the best ``candidates * k`` by code.
    A query may get fewer than ``k`` rows if the lists it probes hold fewer.
    """
    ship_package(vectors.sparkSession)
    asked = _probed(queries, centroids)
    parts = _parts(asked, "_qparts").join(_parts(indexed, "_vparts"), "list")  # a row a list
    part_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "list").withColumn("_q", part_of("query_id", "_qparts")).withColumn("_v", all_parts("_vparts"))
    left = left.drop("_qparts", "_vparts")
    right = indexed.join(parts, "list").withColumn("_v", part_of("id", "_vparts")).withColumn("_q", all_parts("_qparts"))
    right = right.drop("_qparts", "_vparts")
    most = candidates * k

    def best_of_part(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": asked["query_id"].slice(0, 0), "id": held["id"].slice(0, 0), "score": pa.array([], pa.float64())}
        if not asked.num_rows or not held.num_rows:
            return pa.table(out)
        bytes_of = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
        units = bytes_of(asked["unit"], "<f4")
        codes = bytes_of(held["code"], np.int8).astype(np.float32) * held["step"].to_numpy().astype(np.float32)[:, None]
        who, what, score = [], [], []
        ids = np.asarray(held["id"].to_pandas()) if skip_self else None
        for i, (qid, unit) in enumerate(zip(asked["query_id"].to_pylist(), units)):
            found = codes @ unit
            if skip_self:
                found[ids == qid] = -np.inf
            cut = min(most, len(found))
            best = np.argpartition(-found, cut - 1)[:cut]
            best = best[found[best] > -np.inf]
            who.append(np.full(len(best), i))
            what.append(best)
            score.append(found[best])
        take = lambda c, at: c.combine_chunks().take(pa.array(np.concatenate(at)))
        return pa.table({"query_id": take(asked["query_id"], who), "id": take(held["id"], what), "score": np.concatenate(score).astype(np.float64)})

    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    keys = ["list", "_q", "_v"]
    by_code = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of_part, schema)
    chosen = ranked(by_code, most).select("query_id", "id")
    near = chosen.join(vectors.select("id", F.col("vector").alias("_near")), "id")
    exact = near.join(queries.select("query_id", "vector"), "query_id")
    return ranked(exact.select("query_id", "id", F.round(cosine(F.col("vector"), F.col("_near")), SCORE_DIGITS).alias("score")), k)


def topk(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = False) -> tuple[DataFrame, Centroids, DataFrame]:
    """Fit, index and search in one; the result, the centroids with their number of probes, and the index."""
    centroids = fit(vectors)
    centroids.probes = probes_needed(queries, vectors, centroids, k, skip_self)
    indexed = index(vectors, centroids)
    return search(queries, vectors, indexed, centroids, k, skip_self), centroids, indexed


def report(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """One row: recall against the exact search, and the shares of all pairs that were scored by code and exactly."""
    near, centroids, indexed = topk(queries, vectors, k, skip_self)
    exact = cosine_topk(queries, vectors, k, skip_self)
    ids = ["query_id", "id"]
    hits = exact.select(*ids).join(near.select(*ids, F.lit(1).alias("hit")), ids, "left")
    recall = hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
    asked = _probed(queries, centroids)
    lengths = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    coded = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked")).join(lengths, "list")
    coded = coded.agg(F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0)).alias("coded"))
    asked_n, held_n = (df.agg(F.count("vector")).scalar() for df in (queries, vectors))
    pairs, coded_pairs = asked_n * held_n, coded.scalar()
    return recall.select(
        F.lit(k).alias("k"), F.lit(len(centroids.vectors)).alias("lists"), F.lit(centroids.probes).alias("probes"), "neighbours", "found",
        F.try_divide("found", "neighbours").alias("recall"), F.try_divide(coded_pairs, pairs).alias("coded_share"),
        F.try_divide(F.least(coded_pairs, asked_n * F.lit(CANDIDATES * k)), pairs).alias("scored_share"),
    )
