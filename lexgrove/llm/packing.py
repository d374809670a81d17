"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids are followed by one end id; a longer document is cut into full
pieces, the first of which may be shorter. Pieces are packed online: each goes to
the open sequence with the least room that still holds it, found in a bitset
keyed by free space; at most ``OPEN`` sequences are open in a task, and when none
fits the fullest closes first. A task thus needs the same small memory however many
pieces it reads. Pieces are dealt evenly to tasks of about ``TASK_TOKENS`` tokens.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
as documents of their own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed, columns, ship_package

SEQUENCE = 1024
END_ID = 2
OPEN = 128
TASK_TOKENS = 8_000_000
#: Words after which the older half of what a Python worker remembers goes.
REMEMBERED = 200_000
#: Pre-tokenisation of a byte-level tokenizer with use_regex (fixed value).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_ODD = ["  ", " \n", "\n ", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE as ranks of byte strings; null unless ids rise with the merges."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in its tokens
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    if model["type"] != "BPE" or any(x >= y for x, y in zip(made, made[1:])):
        return None
    tokens = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    if any(c not in tokens for c in letters) or min(made, default=0) <= max(tokens[c] for c in letters):
        return None
    return {bytes(letters[c] for c in t): i for t, i in tokens.items()}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is split at each single space that has no white space beside it. A
    byte-level BPE with the usual pre-tokenisation never joins across such a space, so
    the ids of the words, each with its space, put together are those of the text;
    ids of words met lately are remembered. New words are encoded from the tokenizer's own
    vocabulary by a faster BPE, whose ids are compared with the tokenizer's on the first words
    of every worker; should they differ, the tokenizer encodes all.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.recent: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of text behind an id
        for token, number in self.tokenizer.get_vocab().items():
            self.size[number] = len(token.encode()) if token in self.added else len(token)
        content = json.loads(tokenizer_json)
        level = {k: (content["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        usual = level == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not content["normalizer"]
        ranks = _ranks(content["model"]) if usual else None
        self.fast = self._by_tokenizer
        if ranks:
            import tiktoken

            bpe = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = bpe.encode_ordinary
        self.compared = not ranks

    def _by_tokenizer(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def words(self, text: str) -> list[str]:
        if not any(map(text.__contains__, _ODD)):  # white space is single spaces and line breaks, never side by side
            return text.replace(" ", "\0 ").split("\0")
        first, *rest = _BETWEEN_WORDS.split(text)
        return [first, *[" " + word for word in rest]]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word: words that may stand next to each other are encoded as one text and cut apart again."""
        out, joined = {}, []
        for w in words:
            if w[:1] == " " and not w[1:2].isspace() and not w[-1].isspace() and not any(a in w for a in self.added):
                joined.append(w)
            else:
                out[w] = np.array(self._by_tokenizer(w), "<u4").tobytes()
        text = "".join(joined)
        ids = self.fast(text)
        if not self.compared:
            self.compared = True
            if ids != self._by_tokenizer(text):
                self.fast = self._by_tokenizer
                ids = self.fast(text)
        ids = np.array(ids, "<u4")
        ends = np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in joined), np.int64, len(joined)))
        after = np.concatenate(([0], np.cumsum(self.size[ids])))
        bounds = np.searchsorted(after, np.concatenate(([0], ends)))
        if not np.array_equal(after[bounds[1:]], ends):
            raise ValueError("the tokenizer joins across a space between words")
        data, cuts = ids.tobytes(), (4 * bounds).tolist()
        out.update(zip(joined, [data[x:y] for x, y in zip(cuts, cuts[1:])]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) if t else [] for t in texts]
        if len(self.recent) > REMEMBERED:  # the older half goes, but for what is asked for again
            self.known, self.recent = self.recent, {}
        here = set().union(*split).difference(self.recent)  # looks each word up; ``-`` with keys visits all that is remembered
        for word in here & self.known.keys():
            self.recent[word] = self.known[word]
        unknown, long = list(here.difference(self.recent)), {}
        for i in range(0, len(unknown), 4096):
            for word, ids in self._encoded(unknown[i : i + 4096]).items():
                (self.recent if len(word) <= 64 else long)[word] = ids
        if not long:
            return [b"".join(map(self.recent.__getitem__, words)) for words in split]
        return [b"".join([long[w] if w in long else self.recent[w] for w in words]) for words in split]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    """The worker's encoder for a tokenizer: tasks that follow each other keep what it remembers."""
    name = hash(tokenizer_json)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tokenizer_json)
    return _ENCODERS[name]


def cut(ids: bytes) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, its end id included."""
    n = len(ids) // 4
    first = n % SEQUENCE or min(n, SEQUENCE)
    bounds = [0, *range(first, n + 1, SEQUENCE)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def pieces(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all pieces; no shuffle.

    The tokenizer's file is read by the driver and sent along (a few MB, whatever the corpus).
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_file, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cuts = [cut(ids + end) for ids in encoder(texts)]
                flat = [c for doc in cuts for c in doc]
                row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                piece, start, length, crc = zip(*flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = columns(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return narrow.mapInArrow(run, _PIECE.format(id=narrow.schema["doc_id"].dataType.simpleString()))


class BestFit:
    """Bounded-space online best-fit: gives each length a (sequence, offset)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.free = 0  # bit f: a sequence with f places free is open
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open = self.n_made = 0

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(room)
        else:
            if self.n_open == self.most_open and length < self.size:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            room, sequence = self.size, self.n_made
            self.n_made += 1
        if room > length:
            self.open[room - length].append(sequence)
            self.free |= 1 << (room - length)
            self.n_open += 1
        return sequence, self.size - room

    def _take(self, room: int) -> int:
        stack = self.open[room]
        sequence = stack.pop()
        if not stack:
            self.free &= ~(1 << room)
        self.n_open -= 1
        return sequence


def pack(rows: DataFrame) -> DataFrame:
    """``rows(length, ...)`` with ``sequence_id`` and ``offset``. Rows must be given from a written table
    or checkpoint: a task that runs again then packs the same rows in the same order."""
    ship_package(rows.sparkSession)
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-int(tokens) // TASK_TOKENS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        packer, first = BestFit(SEQUENCE, OPEN), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            placed = np.array(list(map(packer.put, lengths)), np.int64).reshape(-1, 2)
            table = pa.Table.from_batches([batch])
            table = table.append_column("sequence_id", pa.array(placed[:, 0] + first))
            yield from table.append_column("offset", pa.array(placed[:, 1])).to_batches()

    return rows.repartition(tasks).mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack(checkpointed(pieces(docs, tokenizer_file)))
