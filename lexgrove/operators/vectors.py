"""Vector top-k: exact cosine search of a table of queries against a table.

A set of queries up to a checked size is sent to every task, which scores its
share of the vectors by matrix product and keeps a running best k per query: one
scan, and a shuffle of at most ``tasks x queries x k`` small rows. Many queries, as
when every vector asks, are dealt out to tasks instead, and blocks of the vectors are
sent to all: ``blocks x queries x k`` rows. Where there are too many blocks for that,
blocks of queries meet blocks of vectors in one task each; no pair
leaves a task unless it is among the block's best k. All ways give the same
rows. Scores are rounded before ranking so that ties are broken by id, not by
floating-point noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.session import ship_package

SCORE_DIGITS = 9
_TIE = 2 * 10.0**-SCORE_DIGITS  # scores further apart are not equal once rounded
BROADCAST_QUERY_VALUES = 8_000_000  # numbers; 64 MB as doubles
BLOCK_VALUES = 8_000_000  # numbers of one side of a block
MANY_QUERIES = 4096  # from here on, and unless the vectors are several times as many, the queries are dealt out
SENT_BLOCKS = 32  # blocks of vectors sent to all tasks at most, 64 MB each as doubles
TASK_PAIRS = 250_000_000  # pairs that a task scores, about half a second
TASK_QUERIES = 4096  # but so many queries at least, for which a block is worth its loading
LSH_BUCKET = 64  # vectors of one bucket, on average, at the least
LSH_TABLES = 64  # tables at most
LSH_RECALL = 0.95  # on sampled queries; what all queries get may be a little less
LSH_SAMPLE = 200
_SCORE_TILE = 500_000  # scores held at once by a task
_SLAB_VALUES = 500_000  # numbers of the vectors that a tile of queries meets at once
_PAIR_VALUES = 1_000_000  # numbers of the pairs scored at once


def l2_normalised(vector: Column) -> Column:
    """Unit-length copy of a vector column; a zero vector stays as it is."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns of one row, inside the JVM; 0 for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a list column; zero vectors score 0 against everything."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (rows and (widths != widths[0]).any()):
        raise ValueError(f"vectors of different widths, or null ones, in one table: {sorted(set(widths.tolist()), key=str)}")
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = flat.reshape(rows, -1) if rows else np.zeros((0, 1))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return out / norms


def _order_codes(ids: pa.Array) -> np.ndarray:
    """Numbers that sort like the ids, whatever their type."""
    return np.unique(np.asarray(ids.to_pandas()), return_inverse=True)[1].ravel()


def _cut(query: np.ndarray, ids: pa.Array, score: np.ndarray, k: int):
    """Best k rows per query number: highest score, then lowest id."""
    order = np.lexsort((_order_codes(ids), -score, query))
    query, score = query[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = place < k
    return query[best], ids.take(pa.array(order[best])), score[best]


def _tops(scores: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The ``k`` highest of the given ones and of scores of each row, none twice; the lowest is a bound that no best ``k`` is below.

    Every ``width``-th score is put in a group, and the groups' maxima stand for all scores:
    far cheaper than a partition of all, and few others are above the bound.
    """
    n, k = scores.shape[1], best.shape[1]
    width = min(64, n // (4 * k))
    if width < 4:
        tops = scores
    else:
        tops = scores[:, : n // width * width].reshape(len(scores), width, -1).max(axis=1)
    tops = np.where(np.isnan(tops), -np.inf, tops)  # no number is no hit
    both = np.concatenate([best, tops], axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]


def _same_ids(qids: pa.Array, ids: pa.Array):
    """Function of a tile of queries and a slab of vectors: row and column numbers of equal ids there."""
    asked, held = np.asarray(qids.to_pandas()), np.asarray(ids.to_pandas())
    if asked.dtype == object or held.dtype == object:
        return lambda rows, cols: np.nonzero(asked[rows, None] == held[None, cols])
    order = np.argsort(held, kind="stable")
    ordered = held[order]
    first, last = np.searchsorted(ordered, asked, "left"), np.searchsorted(ordered, asked, "right")
    last = np.where(asked == asked, last, first)  # no number equals nothing

    def pairs(rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
        counts = last[rows] - first[rows]
        row = np.repeat(np.arange(len(counts)), counts)
        col = order[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[rows], counts)]
        here = (col >= cols.start) & (col < cols.stop)
        return row[here], col[here] - cols.start

    return pairs


def _exact_scores(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores of pairs, a bounded number of them at once."""
    step = max(1, _PAIR_VALUES // max(1, queries.shape[1]))
    parts = [np.einsum("ij,ij->i", queries[row[i : i + step]], vectors[col[i : i + step]]) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _block_best(
    qids: pa.Array, queries: np.ndarray, ids: pa.Array, vectors: np.ndarray, k: int, skip_self: bool
):
    """Query numbers, ids and scores of the best k of one block for each query.

    Candidates are found in single precision, all that its error could hide included, and scored in double.
    """
    if len(queries) and len(vectors) and queries.shape[1] != vectors.shape[1]:
        raise ValueError(f"vectors of different widths: {queries.shape[1]} and {vectors.shape[1]}, ids from {ids[0]}")
    place_of = _order_codes(ids)
    same = _same_ids(qids, ids) if skip_self else None
    coarse_q, coarse_v = queries.astype(np.float32), vectors.astype(np.float32)
    # inputs and sums of ``width`` products of unit rows are off by at most width + 2 halves of a last place, on both sides;
    # rows that tie with the k-th score, once rounded, are still candidates
    slack = np.float32((vectors.shape[1] + 8) * 2.0**-23 + _TIE)
    slabs = max(1, -(-len(ids) * vectors.shape[1] // _SLAB_VALUES))
    slab = max(1, -(-len(ids) // slabs))
    tile = max(1, _SCORE_TILE // slab)
    out_q, out_i, out_s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for start in range(0, len(qids), tile):
        rows = slice(start, start + tile)
        asked = coarse_q[rows]
        best = np.full((len(asked), k), -np.inf, np.float32)
        found = []
        for left in range(0, len(ids), slab):
            cols = slice(left, left + slab)
            scores = asked @ coarse_v[cols].T
            if same is not None:
                scores[same(rows, cols)] = -np.inf
            best = _tops(scores, best)
            at = np.flatnonzero(scores >= best.min(axis=1, keepdims=True) - slack)
            value = scores.ravel()[at]
            row, col = np.divmod(at, scores.shape[1])
            found.append((row, col + left, value))
        row, col, value = (np.concatenate(parts) for parts in zip(*found))
        near = (value >= best.min(axis=1)[row] - slack) & (value > -np.inf)
        row, col = row[near], col[near]
        score = np.round(_exact_scores(queries[rows], vectors, row, col), SCORE_DIGITS)
        order = np.lexsort((place_of[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out_q.append(row[kept] + start)
        out_i.append(col[kept])
        out_s.append(score[kept])
    return np.concatenate(out_q), ids.take(pa.array(np.concatenate(out_i))), np.concatenate(out_s)


def _hit_batch(qids: pa.Array, query: np.ndarray, ids: pa.Array, score: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [qids.take(pa.array(query)), ids, pa.array(score, pa.float64())],
        names=["query_id", "id", "score"],
    )


def _hit_schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Best k per query with ``rank``, by descending score and ascending id."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _scan_with(queries: pa.Table, vectors: DataFrame, k: int, skip_self: bool, schema) -> DataFrame:
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(
        (queries["query_id"].combine_chunks(), _matrix(queries["vector"]))
    )

    def best_of_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        best = None
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            ids = batch.column("id")
            found = _block_best(qids, matrix, ids, _matrix(batch.column("vector")), k, skip_self)
            if best is not None:
                merged = pa.concat_arrays([best[1], found[1]])
                found = _cut(
                    np.concatenate([best[0], found[0]]),
                    merged,
                    np.concatenate([best[2], found[2]]),
                    k,
                )
            best = found
        if best is not None:
            yield _hit_batch(qids, *best)

    return vectors.select("id", "vector").mapInArrow(best_of_share, schema)


def _deal_to(queries: DataFrame, n: int, vectors: DataFrame, n_vectors: int, blocks: int, k: int, skip_self: bool, schema) -> DataFrame:
    """Best k of every block of vectors, for queries dealt out to tasks."""
    context = vectors.sparkSession.sparkContext
    pairs = n * -(-n_vectors // blocks)
    dealt = queries.repartition(max(1, min(-(-pairs // TASK_PAIRS), -(-n // TASK_QUERIES))))
    keyed = vectors.withColumn("_block", _block_key("id", blocks))
    best = None
    for block in range(blocks):
        held = keyed.where(F.col("_block") == block).select("id", "vector").toArrow()
        shared = context.broadcast((held["id"].combine_chunks(), _matrix(held["vector"])))
        part = dealt.mapInArrow(_best_of_batches(shared, k, skip_self), schema)
        best = part if best is None else best.unionByName(part)
    return best


def _best_of_batches(shared, k: int, skip_self: bool):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = shared.value
            if batch.num_rows and len(ids):
                qids = batch.column("query_id")
                yield _hit_batch(qids, *_block_best(qids, _matrix(batch.column("vector")), ids, matrix, k, skip_self))

    return best


def _block_key(id_col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def _cogrouped(
    queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, skip_self: bool, schema
) -> DataFrame:
    """Best k inside every key that holds queries and vectors."""

    def best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(
                {
                    "query_id": left["query_id"].slice(0, 0),
                    "id": right["id"].slice(0, 0),
                    "score": pa.array([], pa.float64()),
                }
            )
        qids = left["query_id"].combine_chunks()
        best = _block_best(
            qids,
            _matrix(left["vector"]),
            right["id"].combine_chunks(),
            _matrix(right["vector"]),
            k,
            skip_self,
        )
        return pa.Table.from_batches([_hit_batch(qids, *best)])

    return (
        queries.groupBy(*keys)
        .cogroup(vectors.groupBy(*keys))
        .applyInArrow(best_of_block, schema)
    )


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    skip_self: bool = False,
    broadcast_values: int = BROADCAST_QUERY_VALUES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(query_id, rank, id, score)``: exact best k vectors for every query.

    ``queries(query_id, vector)`` and ``vectors(id, vector)``. With ``skip_self``
    a vector is not a hit of the query with the same id. Rows without a vector take
    no part; vectors of different widths are an error.
    """
    ship_package(vectors.sparkSession)
    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    vectors = vectors.select("id", "vector").where(F.col("vector").isNotNull())
    schema = _hit_schema(queries, vectors)
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")
    ).first()
    n, width = size["n"], size["width"] or 0
    few = n * width <= broadcast_values
    n_vectors = 0 if few and n < MANY_QUERIES else vectors.count()
    if few and (n < MANY_QUERIES or 4 * n <= n_vectors):
        partial = _scan_with(queries.toArrow(), vectors, k, skip_self, schema)
        return ranked(partial, k)
    q_blocks = max(1, -(-n * width // block_values))
    v_blocks = max(1, -(-n_vectors * width // block_values))
    if v_blocks <= SENT_BLOCKS:
        return ranked(_deal_to(queries, n, vectors, n_vectors, v_blocks, k, skip_self, schema), k)
    left = queries.withColumn("_q", _block_key("query_id", q_blocks)).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )
    right = vectors.withColumn("_v", _block_key("id", v_blocks)).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    return ranked(_cogrouped(left, right, ["_q", "_v"], k, skip_self, schema), k)


def tagged_topk(
    queries: DataFrame, vectors: DataFrame, ks: dict[str, int], broadcast_values: int = BROADCAST_QUERY_VALUES
) -> DataFrame:
    """``(query_id, tag, rank, id, score)``: exact best ``ks[tag]`` vectors with that tag for every tagged query.

    ``queries(query_id, tag, vector)``; ``vectors(id, vector, tags)`` with an array of tags. All queries share each scan
    of the vectors; those beyond ``broadcast_values`` numbers are asked in further blocks, a scan each.
    """
    ship_package(vectors.sparkSession)
    queries = queries.select("query_id", "tag", "vector").where(F.col("vector").isNotNull() & F.col("tag").isin(*ks))
    vectors = vectors.select("id", "vector", "tags").where(F.col("vector").isNotNull() & (F.size("tags") > 0))
    fields = _hit_schema(queries, vectors).fields
    schema = T.StructType([fields[0], T.StructField("tag", T.StringType()), *fields[1:]])
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    blocks = max(1, -(-size["n"] * (size["width"] or 0) // broadcast_values))
    dealt = queries.withColumn("_block", _block_key("query_id", blocks))
    best = None
    for block in range(blocks):
        part = _scan_tagged(dealt.where(F.col("_block") == block).toArrow(), vectors, ks, schema)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), F.col("id"))
    most = F.create_map(*[F.lit(x) for pair in ks.items() for x in pair])
    placed = best.withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= most[F.col("tag")]).select("query_id", "tag", "rank", "id", "score")


def _scan_tagged(queries: pa.Table, vectors: DataFrame, ks: dict[str, int], schema: T.StructType) -> DataFrame:
    sides = {}
    for tag in ks:
        own = queries.filter(pa.compute.equal(queries["tag"], tag)).combine_chunks()
        if own.num_rows:
            sides[tag] = (own["query_id"].combine_chunks(), _matrix(own["vector"]))
    shared = vectors.sparkSession.sparkContext.broadcast(sides)

    def best_of_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix, tags = batch.column("id"), _matrix(batch.column("vector")), batch.column("tags")
            row = np.repeat(np.arange(batch.num_rows), tags.value_lengths().to_numpy(zero_copy_only=False))
            names = np.asarray(tags.flatten().to_pandas())
            for tag, (qids, asked) in shared.value.items():
                held = np.unique(row[names == tag])
                if not len(held):
                    continue
                found = _block_best(qids, asked, ids.take(pa.array(held)), matrix[held], ks[tag], False)
                if tag in best:
                    old = best[tag]
                    found = _cut(
                        np.concatenate([old[0], found[0]]), pa.concat_arrays([old[1], found[1]]), np.concatenate([old[2], found[2]]), ks[tag]
                    )
                best[tag] = found
        for tag, (query, ids, score) in best.items():
            qids = shared.value[tag][0].take(pa.array(query))
            yield pa.RecordBatch.from_arrays(
                [qids, pa.array([tag] * len(query), pa.string()), ids, pa.array(score, pa.float64())], names=["query_id", "tag", "id", "score"]
            )

    return vectors.mapInArrow(best_of_share, schema)


def _planes(seed: int, tables: int, bits: int, width: int) -> np.ndarray:
    """Fewer tables have the first planes of more."""
    return np.random.default_rng(seed).standard_normal((tables * bits, width))


def _lsh_shape(
    queries: DataFrame, vectors: DataFrame, k: int, width: int, tables: int | None, bits: int | None, seed: int, skip_self: bool
) -> tuple[int, int]:
    """Tables and bits by which sampled queries meet ``LSH_RECALL`` of their exact best k while scoring the fewest vectors.
    What is given is kept."""
    most = max(1, min(24, round(np.log2(max(1, vectors.count() / LSH_BUCKET)))))
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    asked = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(LSH_SAMPLE)
    asked = queries.sparkSession.createDataFrame(asked.toArrow(), asked.schema)
    near = cosine_topk(asked, vectors, k, skip_self).select("query_id", "id")
    found = near.join(vectors.select("id", F.col("vector").alias("_near")), "id").join(asked, "query_id")
    pairs = found.select("vector", "_near").toArrow()
    if not pairs.num_rows:
        return tables or 8, bits or most
    left, right = _matrix(pairs["vector"]), _matrix(pairs["_near"])
    best = None
    for b in [bits] if bits else range(1, most + 1):
        planes = _planes(seed, tables or LSH_TABLES, b, width)
        same = ((left @ planes.T > 0) == (right @ planes.T > 0)).reshape(len(left), -1, b).all(axis=2)
        recall = np.logical_or.accumulate(same, axis=1).mean(axis=0)
        if recall[-1] >= LSH_RECALL:
            t = tables or int(np.argmax(recall >= LSH_RECALL)) + 1
            if best is None or t / (1 << b) < best[0] / (1 << best[1]):
                best = t, b
    return best or (tables or LSH_TABLES, bits or 1)


def lsh_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    width: int,
    tables: int | None = None,
    bits: int | None = None,
    seed: int = 42,
    skip_self: bool = False,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Approximate best k by random hyperplanes; recall is measured against exact.

    Every table assigns a vector to one of ``2**bits`` buckets; a query meets the
    vectors of its bucket in each table. Unless both are given, ``tables`` and ``bits``
    are chosen by the recall that ``LSH_SAMPLE`` queries would have against their exact
    best k, at least ``LSH_RECALL``, so that recall does not fall as the input grows. Where
    vectors lie evenly in all directions this scores more pairs than an exact scan; the inverted
    file (``inverted_file``) suits such data better. A query whose buckets are nearly empty may get fewer than ``k`` rows. A bucket above
    ``block_values`` numbers on either side is split into parts, and every part of one side meets every
    part of the other.
    """
    ship_package(vectors.sparkSession)
    if tables is None or bits is None:
        tables, bits = _lsh_shape(queries, vectors, k, width, tables, bits, seed, skip_self)
    planes = _planes(seed, tables, bits, width)
    weights = 1 << np.arange(bits)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = (_matrix(batch.column(1)) @ planes.T > 0).reshape(-1, tables, bits)
            codes = (signs @ weights).astype(np.int32)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), listed],
                names=[batch.schema.names[0], "vector", "codes"],
            )

    def bucketed(df: DataFrame, id_col: str) -> DataFrame:
        df = df.select(id_col, "vector")
        schema = T.StructType([*df.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
        return df.mapInArrow(keys_of, schema).select(
            id_col, "vector", F.posexplode("codes").alias("_table", "_bucket")
        )

    left, right = bucketed(queries, "query_id"), bucketed(vectors, "id")
    bucket = ["_table", "_bucket"]

    def parts_of(df: DataFrame, name: str) -> DataFrame:
        blocks = F.ceil(F.count(F.lit(1)) * F.lit(width) / F.lit(block_values))
        return df.groupBy(*bucket).agg(blocks.cast("int").alias(name))

    def own_part(id_col: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(parts)).cast("int")

    def all_parts(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    # at most tables * 2**bits rows
    parts = parts_of(left, "_qparts").join(parts_of(right, "_vparts"), bucket)
    left = left.join(parts, bucket).withColumn("_q", own_part("query_id", "_qparts"))
    left = left.withColumn("_v", all_parts("_vparts")).drop("_qparts", "_vparts")
    right = right.join(parts, bucket).withColumn("_v", own_part("id", "_vparts"))
    right = right.withColumn("_q", all_parts("_qparts")).drop("_qparts", "_vparts")
    schema = _hit_schema(queries, vectors)
    found = _cogrouped(
        left, right, [*bucket, "_q", "_v"], k, skip_self, schema
    )
    return ranked(found.dropDuplicates(["query_id", "id"]), k)
