"""Repeated byte strings across documents, by suffix arrays over shards of cells.

A byte is removed if a 50-byte string over it also starts in a document with a smaller
doc_id. Every 50-byte window belongs to the smallest hashed 24-byte string in it, its
anchor; a cell is the text under consecutive windows of one document with one anchor.
Equal windows have equal anchors, so:

1. Documents are put together in batches, each written once with the places of its cells.
2. Anchors are counted over all documents. A cell whose anchor is in one document only holds
   no window of another.
3. The other cells go, each distinct text once per batch with its smallest doc_id, to the shard of
   their anchor. A shard joins its distinct cells, builds the suffix array by induced sorting and the
   permuted common prefixes; neighbours with 50 bytes in common are equal windows, and the smallest doc_id
   of such a group is the answer for each of its windows.
4. A batch marks the windows whose answer is smaller than the document's own id and cuts their bytes out.

A batch sends one message to each shard, or, with many shards, to each block of shards, whose suffix arrays are
then built one after the other in one task; so messages stay large when the corpus grows.

Cells of an anchor that is in more than ``COMMON`` documents are sent window by window, by the window's
own hash, so that no shard gets all documents with a common line.

Defined cases: a null text is empty; texts under 50 bytes keep all bytes; documents with equal
doc_ids (repeated rows) don't remove from each other; a null doc_id counts as larger than all
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.blobs import gaps, narrow, packed, shard_of, unpacked
from lexgrove.llm.common import checkpointed, columns, shared_folder, ship_package, shuffle_width
from lexgrove.llm.suffix_array import _words, permuted_prefixes, suffix_array

WINDOW = 50
ANCHOR = 24
COMMON = 1000
BATCH_BYTES = 8_000_000
#: Bytes of corpus for one shard of the suffix arrays and for one of the anchor count.
BYTES_A_SHARD = 4_000_000
BYTES_A_COUNT = 16_000_000
LEAST_SHARDS = 64
#: Beyond so many, shards are asked in blocks of up to so many, one message a batch and block: fewer, larger messages.
BLOCKS = 256
SHARDS_A_BLOCK = 16
_NO_ID = np.iinfo(np.int64).max
_SEPARATOR = 0xFF  # in no UTF-8 text
_SPAN = WINDOW - ANCHOR + 1
_PART = 1 << 16


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, anchor, counts) of texts that follow each other in ``data``: the first window of each cell and the place of
    its anchor, and how many cells each text has. Cells of a text follow each other."""
    start = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - WINDOW + 1, 0)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    words, place = _words(data), np.empty(n, np.int64)
    for at in range(0, n, _PART):
        size = min(_PART, n - at)
        key = _hash24(words, at, size + _SPAN - 1)
        key &= ~np.uint64(0xFFFFFFFF)
        key |= np.arange(len(key), dtype=np.uint64)  # the leftmost of equal ones
        width = 1
        while 2 * width <= _SPAN:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        key = np.minimum(key[: size], key[_SPAN - width : _SPAN - width + size])
        place[at : at + size] = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
    new = np.concatenate(([True], place[1:] != place[:-1]))
    new[start[windows > 0]] = True
    new &= _inside(lengths, windows)[:n]  # windows over the border of two texts are none
    first = np.flatnonzero(new)
    ends = np.searchsorted(first, np.cumsum(lengths))
    return first, place[first], np.diff(ends, prepend=0)


def _inside(lengths: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each place of texts that follow each other whether a window starts there."""
    flags = np.tile([True, False], len(lengths))
    return np.repeat(flags, np.column_stack((windows, lengths - windows)).ravel())


def _hash24(words: np.ndarray, at, size: int | None = None) -> np.ndarray:
    """Hash of the 24 bytes from ``at`` on: a first place with a size, or an array of places."""
    a, b, c = (words[at + k] if size is None else words[at + k : at + k + size] for k in (0, 8, 16))
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        h = (h ^ (h >> np.uint64(29)) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31)) ^ c) * np.uint64(0x165667B19E3779F9)
        return h ^ (h >> np.uint64(33))


def _batches(docs: DataFrame) -> DataFrame:
    """``batch, n_bytes, body``: documents in batches, with their cells."""

    def run(frames):
        first, number, waiting, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            ids = [d for d, _ in waiting]
            text, lengths = b"".join(t for _, t in waiting), np.array([len(t) for _, t in waiting])
            firsts, places, counts = anchors(np.frombuffer(text, np.uint8), lengths)
            body = packed(ids, text, lengths, counts, _steps(firsts, counts), (places - firsts).astype(np.uint8))
            return pa.RecordBatch.from_pydict({"batch": [first + number], "n_bytes": [size], "body": [body]})

        for frame in frames:
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                waiting.append((doc_id, data))
                size += len(data) + 16
                if size >= BATCH_BYTES:
                    yield row()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield row()

    return docs.mapInArrow(run, "batch long, n_bytes long, body binary")


def _steps(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First windows, which rise within each document from zero, as steps."""
    step = np.diff(firsts, prepend=0)
    step[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return step.astype(np.uint8)


class _Batch:
    def __init__(self, body: bytes):
        self.ids, text, lengths, counts, steps, offsets = unpacked(body)
        self.text = text
        self.data = np.frombuffer(text, np.uint8)
        self.lengths, self.start = lengths, np.cumsum(lengths) - lengths
        own = np.array([_NO_ID if i is None else int(i) for i in self.ids], np.int64)
        # cells: document, first window, number of windows, anchor (places in the batch's text)
        self.doc = np.repeat(np.arange(len(lengths)), counts)
        rising = np.cumsum(steps.astype(np.int64))
        begin = np.cumsum(counts) - counts
        here = np.flatnonzero(counts > 0)
        base = np.zeros(len(lengths), np.int64)
        base[here] = rising[begin[here]]
        first = rising - base[self.doc]
        self.first = first + self.start[self.doc]
        last = np.append(self.first[1:], 0)
        ends = begin[here] + counts[here] - 1
        last[ends] = (self.start + np.maximum(lengths - WINDOW + 1, 0))[here]
        self.count = last - self.first
        self.anchor = self.first + offsets
        self.own, self.owner = own, own[self.doc]
        self.hash = (_hash24(_words(self.data), self.anchor) >> np.uint64(16)).astype(np.int64)


def _count_requests(batch_id: int, batch: _Batch, n_shards: int):
    """Distinct anchors of a batch with the number of its documents that have each."""
    keys, counts = _distinct_owners(batch.hash, batch.owner)
    for number, mine in _by_shard(shard_of(keys, n_shards)):
        yield number, batch_id, packed(gaps(keys[mine]), narrow(counts[mine]))


def _by_shard(shard: np.ndarray, block: int = 1):
    """The number of each shard, or block of shards, and the places that have it, by shard and then in their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order] // block)) + 1
    return [(int(shard[part[0]] // block), part) for part in np.split(order, cuts) if len(part)]


def _distinct_owners(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how many different owners each has."""
    order = np.argsort(key)
    k, o = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(k)))
    group = np.repeat(np.arange(len(first)), counts)
    several = np.flatnonzero(counts[group] > 1)
    if len(several):
        g, o = group[several], o[several]
        by = np.lexsort((o, g))
        g, o = g[by], o[by]
        again = g[1:][(g[1:] == g[:-1]) & (o[1:] == o[:-1])]
        counts -= np.bincount(again, minlength=len(first))
    return k[first], counts


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard of the anchors: 0, 1 or 2 for each asked one - in one document, in more, in very many."""
    asked = [unpacked(body) for body in frame["body"]]
    keys = [np.cumsum(k.astype(np.int64)) for k, _ in asked]
    every, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate([c for _, c in asked]))
    code = ((total > 1).astype(np.uint8) + (total > COMMON)).astype(np.uint8)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    bodies = [packed(part) for part in np.split(code[number], cuts)]
    return pd.DataFrame({"batch": frame["batch"], "shard": frame["shard"], "body": bodies})


def _cells(batch: _Batch, counted: pd.DataFrame, n_shards: int):
    """Texts to send: (document, start, windows, route) of every cell with an anchor in several documents; cells of
    very common anchors window by window."""
    keys, number = np.unique(batch.hash, return_inverse=True)
    parts = {s: unpacked(body)[0] for s, body in zip(counted["shard"], counted["body"])}
    code = np.zeros(len(keys), np.uint8)
    for s, mine in _by_shard(shard_of(keys, n_shards)):
        code[mine] = parts[s]
    code = code[number]
    some, very = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
    doc = np.concatenate((batch.doc[some], np.repeat(batch.doc[very], batch.count[very])))
    single = _ranges(batch.first[very], batch.count[very])
    start = np.concatenate((batch.first[some], single))
    count = np.concatenate((batch.count[some], np.ones(len(single), np.int64)))
    words = _words(batch.data)
    by_window = _hash24(words, single) ^ (_hash24(words, single + WINDOW - 24) >> np.uint64(7)) ^ _hash24(words, single + 13)
    route = np.concatenate((batch.hash[some], (by_window >> np.uint64(1)).astype(np.int64)))
    return doc, start, count, route


def _distinct(batch: _Batch, start, count):
    """Number of each cell's distinct text, and the distinct texts."""
    return _numbered(batch.text, start, start + count + WINDOW - 1, {})


def _numbered(text: bytes, start: np.ndarray, end: np.ndarray, known: dict[bytes, int]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Number of each part's text in ``known``, which takes in the new ones."""
    name = np.empty(len(start), np.int64)
    for at in range(0, len(start), _PART):
        parts = list(map(text.__getitem__, map(slice, start[at : at + _PART].tolist(), end[at : at + _PART].tolist())))
        new = [t for t in dict.fromkeys(parts) if t not in known]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        name[at : at + _PART] = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
    return name, known


def _cell_requests(batch_id: int, batch: _Batch, counted: pd.DataFrame, n_shards: int, n_count: int, block: int = 1):
    doc, start, count, route = _cells(batch, counted, n_count)
    name, known = _distinct(batch, start, count)
    if not known:
        return
    texts = list(known)
    least = np.full(len(texts), _NO_ID, np.int64)
    np.minimum.at(least, name, batch.own[doc])
    shard = np.zeros(len(texts), np.int64)
    shard[name] = shard_of(route, n_shards)
    size = np.zeros(len(texts), np.int64)
    size[name] = count + WINDOW - 1
    for number, mine in _by_shard(shard, block):
        cuts = np.bincount(shard[mine] % block, minlength=block)  # texts of each shard
        yield number, batch_id, packed(b"".join([texts[i] for i in mine.tolist()]), narrow(size[mine]), least[mine], cuts)


def _least_ids(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of shards: for each window of each cell the smallest doc_id that has it, one shard after the other."""
    asked = []
    for body in frame["body"]:
        text, lengths, ids, cuts = unpacked(body)
        ends, upto = np.append(0, np.cumsum(lengths, dtype=np.int64)), np.append(0, np.cumsum(cuts))
        asked.append([(text, ends[a : b + 1], ids[a:b]) for a, b in zip(upto[:-1], upto[1:])])
    answers = zip(*map(_least_of_shard, zip(*asked)))
    rows = [(batch, int(shard), _runs(np.concatenate(parts))) for batch, shard, parts in zip(frame["batch"], frame["shard"], answers)]
    return pd.DataFrame(rows, columns=["batch", "shard", "body"])


def _least_of_shard(asked) -> list[np.ndarray]:
    """The answers to each of ``(text, ends of the cells, ids)``, by the suffix array of all cells."""
    known: dict[bytes, int] = {}
    numbers = [_numbered(text, ends[:-1], ends[1:], known)[0] for text, ends, _ in asked]
    if not known:
        return numbers
    texts = list(known)
    least = np.full(len(texts), _NO_ID, np.int64)
    np.minimum.at(least, np.concatenate(numbers), np.concatenate([ids for _, _, ids in asked]))
    data = np.frombuffer(bytes([_SEPARATOR]).join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    count = size - WINDOW + 1
    inside = _inside(size + 1, count)[: len(data)]
    order = suffix_array(data)
    common = permuted_prefixes(data, order)
    # a suffix in common for 50 bytes, none of which is the separator, is the same window
    windows = order[inside[order]]
    starts = np.flatnonzero(common[windows] < WINDOW)
    number = (np.cumsum(inside, dtype=np.int32) - 1)[windows]
    lowest = np.minimum.reduceat(np.repeat(least, count)[number], starts)
    answer = np.empty(len(windows), np.int64)
    answer[number] = np.repeat(lowest, np.diff(np.append(starts, len(windows))))
    begin = np.cumsum(count) - count
    return [answer[_ranges(begin[n], count[n])] for n in numbers]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...``, ``count`` of each."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _runs(values: np.ndarray) -> bytes:
    """Values as runs of equal ones."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return packed(values[first], narrow(np.diff(np.append(first, len(values)))))


def _result(batch: _Batch, counted: pd.DataFrame, answered: pd.DataFrame, n_shards: int, n_count: int, block: int = 1) -> pd.DataFrame:
    gone = np.zeros(len(batch.data), bool)  # at first where a window starts that goes
    doc, start, count, route = _cells(batch, counted, n_count)
    name, known = _distinct(batch, start, count)
    if known:
        shard, windows = np.zeros((2, len(known)), np.int64)
        shard[name], windows[name] = shard_of(route, n_shards), count
        order = np.argsort(shard, kind="stable")
        offset = np.zeros(len(known), np.int64)
        offset[order] = np.cumsum(windows[order]) - windows[order]
        parts = {s: np.repeat(*unpacked(body)) for s, body in zip(answered["shard"], answered["body"])}
        least = np.concatenate([parts[s] for s in np.unique(shard // block).tolist()])
        smaller = least[_ranges(offset[name], count)] < np.repeat(batch.own[doc], count)
        gone[_ranges(start, count)[smaller]] = True
    width = 1
    while width < WINDOW:  # each place that has one of the last 50 places marked
        step = min(width, WINDOW - width)
        gone[step:] |= gone[:-step].copy()
        width += step
    text = batch.data[~gone].tobytes()
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    some = np.flatnonzero(batch.lengths)
    start = batch.start[some]
    begins[start] = gone[start]  # a document's runs are its own
    removed, spans = np.zeros((2, len(batch.lengths)), np.int64)
    if len(some):
        removed[some], spans[some] = (np.add.reduceat(x, start, dtype=np.int64) for x in (gone, begins))
    last = np.cumsum(batch.lengths - removed)
    kept = [text[a:b] for a, b in zip((last - batch.lengths + removed).tolist(), last.tolist())]
    digests = [hashlib.sha256(left).hexdigest() for left in kept]
    values = (batch.ids, batch.lengths, removed, spans, digests, kept)
    return pd.DataFrame(dict(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], values)))


def deduplicated(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs(doc_id, text)``; with ``texts``
    also ``kept``, the bytes that are left."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    name, width = f"sa_{uuid.uuid4().hex}", max(16, shuffle_width(spark))
    writer = _batches(rows).write.format("parquet").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(width, "batch").saveAsTable(name)  # joins below move requests and answers, not texts
    table = spark.table(name)
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    n_shards, n_count = (max(LEAST_SHARDS, -(-int(size) // most)) for most in (BYTES_A_SHARD, BYTES_A_COUNT))
    block = min(SHARDS_A_BLOCK, max(1, n_shards // BLOCKS))
    batches = table.select("batch", "body")

    def count_requests(frames):
        for frame in frames:
            for batch_id, body in zip(frame["batch"], frame["body"]):
                asked = list(_count_requests(int(batch_id), _Batch(body), n_count))
                yield pd.DataFrame(asked, columns=["shard", "batch", "body"])

    request = "shard long, batch long, body binary"
    answer = "batch long, shard long, body binary"
    counted = checkpointed(
        batches.mapInPandas(count_requests, request).groupBy("shard").applyInPandas(_count, answer)
    )

    def cell_requests(own, given):
        asked = [r for i, b in zip(own["batch"], own["body"]) for r in _cell_requests(int(i), _Batch(b), given, n_shards, n_count, block)]
        return pd.DataFrame(asked, columns=["shard", "batch", "body"])

    cells = batches.groupBy("batch").cogroup(counted.groupBy("batch")).applyInPandas(cell_requests, request)
    answered = checkpointed(cells.groupBy("shard").applyInPandas(_least_ids, answer))
    said = counted.withColumn("step", F.lit(1)).unionByName(answered.withColumn("step", F.lit(2)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    def results(own, given):
        one, two = given[given["step"] == 1], given[given["step"] == 2]
        out = [_result(_Batch(b), one, two, n_shards, n_count, block)[names] for b in own["body"]]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: [] for n in names})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return batches.groupBy("batch").cogroup(said.groupBy("batch")).applyInPandas(results, schema)
