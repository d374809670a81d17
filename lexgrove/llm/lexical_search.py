"""Ranked lexical search by dense blocked matrix products.

A block of items has a compact vocabulary: the distinct terms of its items. One pass
over the documents keeps, of every document, its length and how often it holds each of
these terms; from that stored table come N, L and the document frequencies. Then every
task multiplies impact tiles (documents x terms) with weight tiles (terms x items) in
float64, as BLAS does it. A tile has so few terms that its sums stay below 2^53, so all
of them are exact; tiles are added in 64-bit integers. After each tile of documents a task
keeps the k best documents of each item, ties by ascending doc_id. What the tasks keep is
narrow, and is ranked in two steps.

Blocks are bounded by items and terms (``ITEMS``, ``TERMS``), so that what a task is sent is
bounded however many items there are; each block passes over the documents.

Defined cases: a null text, or one without terms, has no terms: such a document is not
counted and never found, such an item has no rows; N and L count repeated rows, and these
are ranked one after the other; item rows that repeat an item_id are ranked each by
itself; a null doc_id comes after all others of equal score; an empty table on either
side gives an empty result; a text of any length is read whole, in parts of 4 MB; further
columns are ignored, under any name.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed, shared_folder, ship_package, text_of
from lexgrove.llm.words import word_parts

K = 10
#: A block's items and terms (with repeats across items); an item with more terms is a block by itself.
ITEMS, TERMS = 512, 16_384
#: Documents and terms of a tile.
TILE_DOCS, TILE_TERMS = 512, 2048
#: Parts in which an item's kept documents are ranked before the last step.
PARTS = 64
IMPACT = 1_000_000
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, text: str) -> DataFrame:
    """``pos`` (names a row of ``items``), ``block`` and the item's text; blocks within ``ITEMS`` and ``TERMS``."""
    rows = items.select(F.monotonically_increasing_id().alias("pos"), text_of(f"`{text}`").alias("text"))
    cost = F.length("text") / 2 + 1  # at most so many terms
    rows = rows.withColumn("terms", cost.cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    blocks = max(1, math.ceil(total["items"] / ITEMS), math.ceil(total["terms"] / TERMS))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)))
        sums = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.sum("terms").alias("terms"))
        if not sums.where((F.col("items") > 1) & ((F.col("items") > ITEMS) | (F.col("terms") > TERMS))).take(1):
            return dealt.select("pos", "block", "text")
        blocks *= 2


def terms_of(docs: DataFrame, vocabulary: dict[bytes, int], id: str, text: str) -> DataFrame:
    """``doc, n, ids, counts`` of every document with a term: length, terms of the vocabulary and their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = sent.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths, ends, ids, counts = [], [0], [], []
                for value in part.column(1).to_pylist():
                    held, n = Counter(), 0
                    for words in word_parts(value):
                        n += len(words)
                        held.update(map(number, words))
                    held.pop(None, None)
                    lengths.append(n)
                    ids.extend(held.keys())
                    counts.extend(held.values())
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((ids, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc", "n", "ids", "counts"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), text_of(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, ids array<int>, counts array<long>").where("n > 0")


class Best:
    """The k best (score, doc) of every item seen so far: higher scores, then smaller docs, first."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.floor = np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """Documents as rows, items as columns; what lies below an item's k-th score is left, equals are not."""
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        doc, none = np.concatenate((self.doc, doc[row])), np.concatenate((self.none, none[row]))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        self.item, self.score, self.doc, self.none = item, score[order], doc[order], none[order]
        full = rank == self.k - 1
        self.floor[item[full]] = self.score[full]


def impacts(n: np.ndarray, counts: np.ndarray, total: int, length: int) -> np.ndarray:
    """Impact of each term occurrence count in a document of length n (both of equal shape), below ``IMPACT``."""
    m = 100 - 90 + (90 * n * total) // length
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def scored(stored: DataFrame, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """``item, doc, score``: of every task the k best documents of every item. ``weights`` is terms x items."""
    sent = stored.sparkSession.sparkContext.broadcast(weights)
    most = max(1, int(weights.max(initial=0)))
    width = max(1, min(TILE_TERMS, (_EXACT - 1) // (most * IMPACT)))  # sums of a tile stay below 2^53

    def run(batches):
        whole = sent.value
        tiles = [np.ascontiguousarray(whole[a : a + width]) for a in range(0, len(whole), width)]
        best = Best(whole.shape[1], k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                doc = part.column(0)
                none = doc.is_null().to_numpy(zero_copy_only=False)
                doc = doc.fill_null(_LAST).to_numpy(zero_copy_only=False)
                ids, counts = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                sizes = part.column(2).value_lengths().to_numpy()
                row = np.repeat(np.arange(len(doc)), sizes)
                impact = impacts(part.column(1).to_numpy()[row], counts, total, length)
                sums = np.zeros((len(doc), whole.shape[1]), np.int64)
                for i, tile in enumerate(tiles):
                    dense = np.zeros((len(doc), len(tile)))
                    held = (ids >= i * width) & (ids < i * width + len(tile)) if len(tiles) > 1 else slice(None)
                    dense[row[held], ids[held] - i * width] = impact[held]
                    sums += (dense @ tile).astype(np.int64)
                best.add(sums, doc, none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, mask=best.none), pa.array(best.score)], names=["item", "doc", "score"]
        )

    return stored.mapInArrow(run, "item long, doc long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    named = checkpointed(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")))
    blocked = checkpointed(item_blocks(named, "text"))
    found = None
    for number in [r["block"] for r in blocked.select("block").distinct().orderBy("block").collect()]:
        rows = blocked.where(F.col("block") == number).orderBy("pos").collect()  # within ITEMS and TERMS
        wanted = [sorted({w for part in word_parts(r["text"]) for w in part}) for r in rows]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*wanted)))}
        if not vocabulary:
            continue
        path = f"{folder}/{number}"
        terms_of(docs, vocabulary, doc_id, text).write.parquet(path)
        stored = spark.read.parquet(path)
        all_n = stored.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("length")).first()
        if not all_n["total"]:
            continue
        held = stored.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()
        df = {r["id"]: r["df"] for r in held}
        weights = np.zeros((len(vocabulary), len(rows)))
        for column, words in enumerate(wanted):
            for w in words:
                weights[vocabulary[w], column] = weight(all_n["total"], df.get(vocabulary[w], 0))
        best = scored(stored, weights, all_n["total"], all_n["length"], k)
        places = F.array(*[F.lit(r["pos"]) for r in rows])
        best = best.select(F.get(places, F.col("item").cast("int")).alias("pos"), "doc", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        empty = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc")).limit(0)
        found = empty.select(F.lit(0).cast("long").alias("pos"), "doc", F.lit(0).cast("long").alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    found = found.select("*", part).withColumn("_r", F.row_number().over(Window.partitionBy("pos", "part").orderBy(*order)))
    found = found.where(F.col("_r") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(*order)))
    names = named.select(F.monotonically_increasing_id().alias("pos"), "item_id")
    return found.where(F.col("rank") <= k).join(names, "pos").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
