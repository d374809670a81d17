"""N-gram language-model scores from Elias-Fano tries that are spread over shards.

The corpus is encoded in batches: each holds its own distinct words and its documents as
numbers of them, and is written once. One exchange per order follows. A batch sends
each shard the distinct n-grams that fall to it, as (context node, word), with their
counts in the batch's training documents; a shard adds these up, builds one trie level of
what it has counted - monotone pointers, context-relative word numbers, quantised
smoothed probabilities, all memory-mapped - and answers every batch by successor search.
A batch then knows the nodes from which to ask for the next order. No task ever holds the
vocabulary or the model, and nothing of them is broadcast or brought to the driver but
three totals.

Model: p1(w) = (c + 0.5) / (N + 0.5 (V + 1)); above it, for a context u that has been
seen c(u) times, p(w | u) = (c(u w) + M p') / (c(u) + M), with p' of the context without
its first word. Each p sums to one over the vocabulary and one unknown word. The share
c(u w) / (c(u) + M) is what the trie keeps, in ``1 << 16`` steps of its log odds. The end
token also stands before a text's first word. Trigrams are kept below contexts that were
seen ``DEEP`` times or more, which is all of them; elsewhere the bigram's p holds.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the
empty text in the fold rule; repeated rows are documents of their own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.blobs import gaps, narrow, packed, shard_of, unpacked
from lexgrove.llm.common import columns, shared_folder, ship_package, shuffle_width

FOLDS, HELD_OUT = 5, 1
ORDER = 3
M = 4.0
DEEP = 1
#: Bytes of text in a batch, and entries that one shard may hold of a level.
BATCH_BYTES = 6_000_000
SHARD_ENTRIES = 1_500_000
LEAST_SHARDS = 64
END = b"\n"  # no word: it is white space
_STEPS = 1 << 16
_WIDEST = 28.0


def _held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


# batches


def _encoded(docs: list[tuple]) -> tuple:
    """(doc_ids, held, lengths, sequence, keys): documents of (doc_id, text) as numbers of distinct words,
    each document followed by its end; ``keys`` are the words' 64-bit hashes, sorted."""
    import xxhash

    known: dict[bytes, int] = {}
    parts, lengths = [], []
    for _, text in docs:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(END)
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        lengths.append(len(words))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, 7) >> 1 for w in known), np.int64, len(known))
    keys, number = np.unique(hashed, return_inverse=True)
    sequence = number[np.concatenate(parts)].astype(np.int32)
    return [d for d, _ in docs], np.array([_held_out(d) for d, _ in docs]), np.array(lengths), sequence, keys


def _batches(docs: DataFrame) -> DataFrame:
    """``batch, n_train, body``: one row per batch."""
    from pyspark import TaskContext

    def run(frames):
        first, number, waiting, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            ids, held, lengths, sequence, keys = _encoded(waiting)
            train = int(lengths[~held].sum())
            body = packed(ids, held, narrow(lengths), sequence.astype(np.min_scalar_type(len(keys))), gaps(keys))
            return pa.RecordBatch.from_pydict({"batch": [first + number], "n_train": [train], "body": [body]})

        for frame in frames:
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                waiting.append((doc_id, text))
                size += len(text or "") + 16
                if size >= BATCH_BYTES:
                    yield row()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield row()

    return docs.mapInArrow(run, "batch long, n_train long, body binary")


class _Batch:
    """A batch with what shards have answered so far."""

    def __init__(self, body: bytes):
        self.ids, self.held, lengths, sequence, steps = unpacked(body)
        self.lengths = lengths.astype(np.int64)
        self.sequence = sequence.astype(np.int32)
        self.keys = np.cumsum(steps.astype(np.int64))
        self.ends = np.cumsum(self.lengths)
        self.train = np.repeat(~self.held, self.lengths)
        self.before = np.empty_like(self.sequence)  # the word before: for a first word, the end token
        self.before[1:] = self.sequence[:-1]
        self.before[:1] = self.sequence[-1:]


def _entries(batch: _Batch, level: int, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of a level as (parent, word, context count, count in training documents), sorted by parent
    and word; ``state[level]`` gets, for every token, the index of its entry or -1."""
    if level == 1:
        n = len(batch.keys)
        state[1] = batch.sequence
        counts = np.bincount(batch.sequence[batch.train], minlength=n)
        return np.zeros(n, np.int64), batch.keys, np.zeros(n, np.int64), counts
    word = state["node"][batch.sequence]
    if level == 2:
        parent, seen = state["node"][batch.before], state["count"][batch.before]
        asked = (parent >= 0) & (word >= 0)
    else:
        # the entry of the token before is the context; a text's first word has none
        entry = np.full(len(batch.sequence), -1, np.int32)
        entry[1:] = state[level - 1][:-1]
        entry[np.concatenate(([0], batch.ends[:-1]))] = -1
        has = entry >= 0
        parent, seen = np.full(len(entry), -1, np.int64), np.zeros(len(entry), np.int64)
        parent[has], seen[has] = state["node", level - 1][entry[has]], state["count", level - 1][entry[has]]
        asked = (parent >= 0) & (word >= 0) & (seen >= DEEP)
    where = np.flatnonzero(asked).astype(np.int32)
    order = where[_order(parent[where], word[where])]
    p, w = parent[order], word[order]
    del where, parent, asked
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (w[1:] != w[:-1]))) if len(p) else np.zeros(0, bool)
    entry_of = np.full(len(word), -1, np.int32)
    entry_of[order] = np.cumsum(new, dtype=np.int32) - 1
    state[level] = entry_of
    counts = np.bincount(entry_of[order], batch.train[order], minlength=int(new.sum())).astype(np.int64)
    return p[new], w[new], seen[order][new], counts


def _order(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by parent and word."""
    wide = int(word.max(initial=0)) + 1
    if (int(parent.max(initial=0)) + 1) * wide < 1 << 63:
        return np.argsort(parent * wide + word)
    return np.lexsort((word, parent))


def _answered(given: list[list], shards: list[int], batch: _Batch) -> dict:
    """Nodes, counts and codes of the batch's entries of every level answered so far; ``given``: (shard, body) of each level."""
    state: dict = {}
    for level, (answers, n_shards) in enumerate(zip(given, shards), 1):
        parent, word, _, _ = _entries(batch, level, state)
        shard = _entry_shard(level, parent, word, n_shards)
        node, count, code = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int32), np.zeros(len(word), np.uint16)
        by_shard = np.argsort(shard, kind="stable").astype(np.int32)
        cut = np.searchsorted(shard[by_shard], np.arange(n_shards + 1))
        for answer in answers if answers is not None else ():
            number = int(answer["shard"])
            mine = by_shard[cut[number] : cut[number + 1]]
            found, places, counts, codes = unpacked(answer["body"])
            hit = mine[np.cumsum(found.astype(np.int64))]
            node[hit], count[hit], code[hit] = np.cumsum(places.astype(np.int64)) * n_shards + number, counts, codes
        if level == 1:
            state["node"], state["count"] = node, count
        state["node", level], state["count", level], state["code", level] = node, count, code
    return state


def _entry_shard(level: int, parent: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """All children of a word pair in one shard; those of a single word, of which some are very common, in 16 groups."""
    if level == 1:
        return shard_of(word, shards)
    return shard_of(parent * 31 + (word & 15 if level == 2 else 0), shards)


def _first_of_parent(parent: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(parent) else np.zeros(0, np.int64)


def _word_steps(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words, which rise below each parent, as steps from one to the next."""
    step, first = np.diff(word, prepend=0), _first_of_parent(parent)
    step[first] = word[first]
    return narrow(step)


def _words_of_steps(parent: np.ndarray, step: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(step.astype(np.int64)), _first_of_parent(parent)
    before = np.zeros(len(first), np.int64)
    before[1:] = total[first[1:] - 1]
    return total - np.repeat(before, np.diff(np.append(first, len(parent))))


def _requests(level: int, entries: tuple, n_shards: int, batch_id: int):
    parent, word, seen, counts = entries
    shard = _entry_shard(level, parent, word, n_shards)
    order = np.argsort(shard, kind="stable")  # entries of a shard keep their order
    parent, word, seen, counts = parent[order], word[order], seen[order], counts[order]
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1)).tolist()
    for number, (a, b) in enumerate(zip(cut, cut[1:])):
        if a < b:
            steps = _word_steps(parent[a:b], word[a:b])
            yield number, batch_id, packed(gaps(parent[a:b]), steps, narrow(seen[a:b]), narrow(counts[a:b]))


def _serve(level: int):
    """One shard: add up the requests, build the level, answer each request."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import tempfile

        from lexgrove.llm.elias_fano import TrieLevel

        asked = []
        for body in frame["body"]:
            parent, word, seen, counts = unpacked(body)
            parent = np.cumsum(parent.astype(np.int64))
            asked.append((parent, _words_of_steps(parent, word), seen, counts))  # counts in the narrow types they came in
        parent, word, seen, counts = (np.concatenate(a) for a in zip(*asked))
        ends = np.cumsum([len(a[0]) for a in asked]).tolist()
        del asked
        order = _order(parent, word)
        parent = parent[order]
        word = word[order]
        new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1]))) if len(parent) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(counts[order], starts, dtype=np.int64) if len(starts) else counts
        distinct = np.empty(len(order), np.int32)  # of each asked entry
        distinct[order] = np.cumsum(new, dtype=np.int32) - 1
        parent, word, seen = parent[starts], word[starts], seen[order[starts]]
        del order, new
        kept = counts > 0
        n_kept, shares = int(kept.sum()), counts[kept] / (seen[kept] + M)
        codes = quantised(shares) if level > 1 else np.zeros(n_kept, np.uint16)
        rows = []
        with tempfile.TemporaryDirectory() as folder:
            trie = TrieLevel(parent[kept], word[kept], folder)
            place = trie.find(parent, word)  # each distinct entry once
            del trie
        counts = counts[kept]
        for batch, a, b in zip(frame["batch"], [0, *ends], ends):
            own = place[distinct[a:b]]
            found = np.flatnonzero(own >= 0)
            at = own[found]
            rows.append((batch, int(frame["shard"].iloc[0]), n_kept,
                         packed(gaps(found), gaps(at), narrow(counts[at]), codes[at])))
        return pd.DataFrame(rows, columns=["batch", "shard", "n_kept", "body"])

    return run


def quantised(share: np.ndarray) -> np.ndarray:
    """Probabilities as even steps of their log odds: fine near one, where a text's score adds up many."""
    odds = np.log(np.maximum(share, 1e-12)) - np.log(np.maximum(1 - share, 1e-12))
    return np.round((np.clip(odds / _WIDEST, -1, 1) + 1) / 2 * (_STEPS - 1)).astype(np.uint16)


def share_of(code: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(code.astype(np.float64) / (_STEPS - 1) * 2 - 1) * _WIDEST))


def _scores(batch: _Batch, state: dict, order: int, total: int, types: int):
    """Per document: n_tokens, n_known, base and model score."""
    count = state["count"][batch.sequence].astype(np.float64)
    p = (count + 0.5) / (total + 0.5 * (types + 1))
    base, known = np.log10(p), count > 0
    for level in range(2, order + 1):
        entry = state[level]
        if level == 2:
            seen, usable = state["count"][batch.before].astype(np.float64), np.ones(len(entry), bool)
        else:
            before = np.full(len(entry), -1, np.int32)
            before[1:] = state[level - 1][:-1]
            before[np.concatenate(([0], batch.ends[:-1]))] = -1
            seen = np.where(before >= 0, state["count", level - 1][before] if len(state["count", level - 1]) else 0, 0)
            usable = seen >= DEEP
        own = np.zeros(len(entry))
        has = entry >= 0
        hit = has.copy()
        hit[has] = state["node", level][entry[has]] >= 0
        own[hit] = share_of(state["code", level][entry[hit]])
        p = np.where(usable, own + M / (seen + M) * p, p)
    starts = np.concatenate(([0], batch.ends[:-1]))
    add = lambda x: np.add.reduceat(x, starts)
    return batch.lengths, add(known.astype(np.int64)), add(base), add(np.log10(p))


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = columns(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # tables are bucketed by batch, so that a batch meets its answers without another shuffle of either
    table = _bucketed(_batches(rows), "batches")
    total = table.agg(F.sum("n_train")).first()[0] or 0
    known = table.select("batch", "body")
    shards: list[int] = []
    types = 0
    for level in range(1, order + 1):
        n_shards = max(LEAST_SHARDS, -(-int(total) // SHARD_ENTRIES))
        asked = known.mapInPandas(_with_answers(shards, _asking(level, n_shards)), "shard long, batch long, body binary")
        served = asked.groupBy("shard").applyInPandas(_serve(level), "batch long, shard long, n_kept long, body binary")
        answer = served.groupBy("batch").agg(F.collect_list(F.struct("shard", "n_kept", "body")).alias(f"answers_{level}"))
        if level < order:
            answer = _bucketed(answer, f"answers_{level}")
        if level == 1:
            kept = answer.select(F.explode("answers_1").alias("a")).select("a.shard", "a.n_kept").distinct()
            types = kept.agg(F.sum("n_kept")).first()[0] or 0
        known = known.join(answer, "batch", "left")
        shards.append(n_shards)

    def finish(batch_id, batch, state):
        n_tokens, n_known, base, model = _scores(batch, state, order, total, types)
        yield pd.DataFrame({
            "doc_id": pd.array(batch.ids, dtype=object), "held_out": batch.held, "n_tokens": n_tokens, "n_known": n_known,
            "train_tokens": np.full(len(n_tokens), total), "base_score": base, "score": model,
        })

    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return known.mapInPandas(_with_answers(shards, finish), schema)


def _bucketed(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by batch."""
    spark = df.sparkSession
    name = f"lm_{what}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(max(16, shuffle_width(spark)), "batch").saveAsTable(name)
    return spark.table(name)


def _asking(level: int, n_shards: int):
    def ask(batch_id, batch, state):
        rows = list(_requests(level, _entries(batch, level, state), n_shards, batch_id))
        yield pd.DataFrame(rows, columns=["shard", "batch", "body"])

    return ask


def _with_answers(shards: list[int], use):
    """Function for ``mapInPandas``: ``use(batch_id, batch, state)`` on every batch with its answers of the levels so far."""
    shards = list(shards)

    def run(frames):
        for frame in frames:
            given = [frame[f"answers_{level}"] for level in range(1, len(shards) + 1)]
            for row, (batch_id, body) in enumerate(zip(frame["batch"], frame["body"])):
                batch = _Batch(body)
                yield from use(int(batch_id), batch, _answered([g.iloc[row] for g in given], shards, batch))

    return run
