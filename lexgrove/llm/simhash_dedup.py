"""SimHash near-duplicates by multi-index hashing.

Contract of the result: one row per input row with ``doc_id``, ``fingerprint``
(16 hex digits) and ``component_id``, the smallest doc_id that is reachable over
links of at most 4 differing bits.

Defined cases: a null or empty text has fingerprint zero; fewer than four words
are one shingle; repeated rows and ties share a fingerprint and so a component;
a component without any non-null doc_id has a null component_id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed, ship_package
from lexgrove.llm.components import components

SHINGLE = 4
DIFFERING = 4
#: Bits of the segments. With three of them, two fingerprints that differ in four
#: bits differ in at most one bit of the first or of the second, or in none of the
#: third; so the first two are probed within one bit and the third exactly.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Fingerprints, or probes, of one bucket that meet in one block.
BLOCK = 4096
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())]
    n = len(shingles)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _BITS_AT_ONCE):
        part = hashes[i : i + _BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp`` (long), one row per row; no shuffle."""
    ship_package(df.sparkSession)
    narrow = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["fp long"])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = [fingerprint(t) for t in table.column("_text").to_pylist()]
            out = table.select(keep).append_column("fp", pa.array(values, pa.int64()))
            yield from out.to_batches()

    return narrow.mapInArrow(run, schema)


def _probes(fps: DataFrame) -> DataFrame:
    """(seg, value, fp, base): each fingerprint at its own segment values (base) and in the
    half ball around them: of two values one bit apart, the one that has the bit looks up the other."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for seg, (low, width, radius) in enumerate(SEGMENTS):
                own = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                parts = [(own, fp, True)]
                if radius:
                    for bit in range(width):
                        has = (own >> np.uint64(bit)) & np.uint64(1) == 1
                        parts.append((own[has] ^ np.uint64(1 << bit), fp[has], False))
                value = np.concatenate([p[0] for p in parts]).astype(np.int64)
                owner = np.concatenate([p[1] for p in parts]).view(np.int64)
                base = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), seg, np.int32)), pa.array(value), pa.array(owner), pa.array(base)],
                    names=["seg", "value", "fp", "base"],
                )

    return fps.mapInArrow(run, "seg int, value long, fp long, base boolean")


def _star(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the pairs (a, b) of one block connect, at most one a row."""
    label = np.arange(len(fp))
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            break
    away = label != np.arange(len(fp))
    return [(fp[away], fp[label[away]])]


def _links_of_runs(run_id: np.ndarray, fp: np.ndarray, base: np.ndarray, rows: np.ndarray):
    """Verified links inside runs of equal run_id; short runs by shifts, long ones as a matrix."""
    if not len(fp):
        return
    starts = np.flatnonzero(np.concatenate(([True], run_id[1:] != run_id[:-1])))
    lengths = np.diff(np.append(starts, len(fp)))
    short = np.repeat(lengths <= 24, lengths)
    longest = int(lengths[lengths <= 24].max(initial=1))
    unsigned = fp.view(np.uint64)
    for lag in range(1, longest):
        i = np.flatnonzero((run_id[lag:] == run_id[:-lag]) & short[lag:])
        j = i + lag
        i, j = i[ok := (base[i] & rows[j]) | (rows[i] & base[j])], j[ok]
        near = np.bitwise_count(unsigned[i] ^ unsigned[j]) <= DIFFERING
        yield fp[i[near]], fp[j[near]]
    for start, length in zip(starts[lengths > 24].tolist(), lengths[lengths > 24].tolist()):
        here = fp[start : start + length]
        values, at = np.unique(here, return_inverse=True)
        left = np.unique(at[base[start : start + length]])
        right = np.unique(at[rows[start : start + length]])
        u, pairs_a, pairs_b = values.view(np.uint64), [], []
        step = max(1, (1 << 21) // max(1, len(right)))
        for i in range(0, len(left), step):
            near = np.bitwise_count(u[left[i : i + step], None] ^ u[None, right]) <= DIFFERING
            x, y = np.nonzero(near)
            pairs_a.append(left[i + x])
            pairs_b.append(right[y])
            if sum(map(len, pairs_a)) > 1 << 22:  # keep what they connect, in less room
                yield from _star(values, np.concatenate(pairs_a), np.concatenate(pairs_b))
                pairs_a, pairs_b = [], []
        if pairs_a:
            yield from _star(values, np.concatenate(pairs_a), np.concatenate(pairs_b))


def near_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect the same distinct fingerprints ``fps(fp)`` as all pairs of at
    most 4 differing bits do. Every pair that shares a bucket is compared; of a bucket with many
    links only enough to connect them are returned.

    A bucket of more than ``BLOCK`` rows is dealt out as blocks (part of its own
    fingerprints x part of all its rows), so that no task holds it whole.
    """
    ship_package(fps.sparkSession)
    probes = checkpointed(_probes(fps))
    sizes = probes.groupBy("seg", "value").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.count(F.lit(1)).alias("n_rows")
    )
    large = sizes.where(f"n_base > 0 and n_rows > {BLOCK}").select(
        "seg", "value",
        F.ceil(F.col("n_base") / BLOCK).cast("int").alias("cuts_base"),
        F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("cuts_rows"),
    )
    one = F.lit(1)
    dealt = probes.join(large, ["seg", "value"], "left").select(
        "seg", "value", "fp", "base",
        F.coalesce("cuts_base", one).alias("cb"), F.coalesce("cuts_rows", one).alias("cr"),
    )
    mine = lambda cuts: F.pmod(F.xxhash64("fp"), F.col(cuts)).cast("int")
    small = dealt.where("cb = 1 and cr = 1").select(
        "seg", "value", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "base", F.lit(True).alias("row")
    )
    cut = dealt.where("cb > 1 or cr > 1")
    as_base = cut.where("base").select(
        "seg", "value", mine("cb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cr") - 1)).alias("j"), "fp",
        "base", F.lit(False).alias("row"),
    )
    as_row = cut.select(
        "seg", "value", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("i"), mine("cr").alias("j"), "fp",
        F.lit(False).alias("base"), F.lit(True).alias("row"),
    )
    keys = ["seg", "value", "i", "j"]
    blocks = small.unionByName(as_base).unionByName(as_row).repartition(*keys).sortWithinPartitions(*keys)

    def run(frames):
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            key = frame[keys].to_numpy()
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))) if len(frame) else np.zeros(0, bool)
            last = int(np.flatnonzero(new)[-1]) if len(frame) else 0
            kept = frame.iloc[last:]  # the last run may go on in the next batch
            yield from links(frame.iloc[:last], np.cumsum(new)[:last])
        if kept is not None:
            yield from links(kept, np.zeros(len(kept), np.int64))

    def links(frame, run_id):
        fp, base, row = (frame[c].to_numpy() for c in ("fp", "base", "row"))
        for a, b in _links_of_runs(np.asarray(run_id), fp.astype(np.int64), base.astype(bool), row.astype(bool)):
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return blocks.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def fingerprint_roots(fps: DataFrame) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint that has a near one."""
    return components(near_links(fps)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for every row of ``docs(doc_id, text)``."""
    rows = checkpointed(with_fingerprint(docs, ["doc_id"]))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = distinct.join(fingerprint_roots(distinct.select("fp")), "fp", "left")
    rooted = checkpointed(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = checkpointed(rooted.join(smallest, "root").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
