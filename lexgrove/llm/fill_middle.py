"""Fill-in-the-middle transformation; the cuts are found by SWAR words.

The UTF-8 bytes of a batch of texts are viewed as 64-bit words. Arithmetic on whole
words marks the high bit of every byte that ends a unit (a line), ``bitwise_count``
counts the marks of a word, running sums of the counts give the word that holds the
k-th mark by binary search, and a multiplication finds its byte inside the word. Marks
of the bytes that start a code point count characters in the same way. Python handles
no line by itself; a text is only sliced at its two cuts.

Form ``plain`` is the text itself, ``psm`` is ``<P>prefix<S>suffix<M>middle`` and ``spm``
is ``<S>suffix<P>prefix<M>middle``. ``restored`` rebuilds the text from output and form.

Defined cases: a null text counts as empty; an empty text, or one that holds a sentinel,
is plain, with null ``prefix_chars`` and ``middle_chars``; prefix, middle and suffix may
be empty; a null key draws as the empty string; repeated rows are transformed alike; an
empty table gives an empty result; a text of any length is read whole (texts are taken
together up to ``SLICE`` bytes, a longer one alone, and no text is cut into blocks);
further columns are ignored, under any name; a kept column that has the name of a
result column is refused with ValueError.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import let
from lexgrove.llm.common import ship_package, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
#: Bytes of text that are marked together.
SLICE = 1 << 24
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def ends(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``; exact, no carry leaves a byte."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that starts a code point (is not of the form 10xxxxxx)."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before ``at``."""
        below = (np.uint64(1) << (np.uint64(8) * (at & 7).astype(np.uint64))) - np.uint64(1)
        return self.before[at >> 3] + np.bitwise_count(self.marks[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte after the k-th mark, k from 1 to the number of marks."""
        word = np.searchsorted(self.before[1:], k)
        rest = (k - self.before[word]).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * _ONES  # each byte: marks up to and with it
        reached = ((running | _HIGH) - rest * _ONES) & _HIGH
        return 8 * word + 9 - np.bitwise_count(reached).astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """``data`` as little-endian words, with zeros up to one word past its end."""
    padded = np.zeros(len(data) // 8 + 1, "<u8")
    padded.view(np.uint8)[: len(data)] = data
    return padded


def _strings(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets), pa.py_buffer(b"".join(values)))


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, plain: np.ndarray, spm: np.ndarray, sentinels, unit: str) -> list[pa.Array]:
    """The columns of ``RESULT`` for texts without null; drawn numbers and drawn forms are given."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    at -= at[0]
    first, last = at[:-1], at[1:]
    words = _words(data)
    lines, points = Marks(ends(words, ord(unit))), Marks(starts(words))
    known = lines.rank(first)
    units = lines.rank(last) - known
    full = last > first
    units += full & (data[np.maximum(last - 1, 0)] != ord(unit)) if len(data) else 0
    for s in sentinels:
        plain = plain | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    plain = plain | ~full

    def after(k: np.ndarray) -> np.ndarray:
        """Byte at which a text's first k units end."""
        inner = (k > 0) & (k < units)
        place = np.where(k > 0, last, first)
        place[inner] = lines.select((known + k)[inner])
        return place

    low, high = np.minimum(h1 % (units + 1), h2 % (units + 1)), np.maximum(h1 % (units + 1), h2 % (units + 1))
    a, b = after(low), after(high)
    counts = [points.rank(a) - points.rank(first), points.rank(b) - points.rank(a)]
    p, s, m = (x.encode() for x in sentinels)
    body, out = data.tobytes(), []
    for i, j, k, z, same, turned in zip(*(x.tolist() for x in (first, a, b, last, plain, spm))):
        if same:
            out.append(body[i:z])
        elif turned:
            out.append(b"".join((s, body[k:z], p, body[i:j], m, body[j:k])))
        else:
            out.append(b"".join((p, body[i:j], s, body[k:z], m, body[j:k])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(units, pa.int64()), pa.array(form, pa.string()),
        *[pa.array(c, pa.int64(), mask=plain) for c in counts], _strings(out),
    ]


def transformed(
    docs: DataFrame, *keep: str, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), unit: str = "\n",
) -> DataFrame:
    """``keep``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row; no shuffle.

    The draws h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``seed:key``: h1 and h2 modulo
    n + 1 give the cuts, ``rate`` is the percentage that is transformed, ``spm`` the percentage of those in suffix
    order. ``unit`` is the ASCII character that ends a unit. No sentinel may hold another, or end as another begins.
    """
    ship_package(docs.sparkSession)
    keep = keep or ("doc_id",)
    if clash := set(keep) & set(RESULT):
        raise ValueError(f"columns {sorted(clash)} are results")
    if len(unit) != 1 or not unit.isascii():
        raise ValueError("a unit ends with one ASCII character")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    kept = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)]
    rows = docs.select(*kept, text_of(f"`{text}`").alias("_text"), digest.alias("_digest"))
    rows = rows.select(*[f"k{i}" for i in range(len(keep))], "_text", *drawn)
    types = [f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)]
    schema = ", ".join([*types, "n long", "form string", "prefix_chars long", "middle_chars long", "output string"])

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                used = int(sizes[row - 1]) if row else 0
                end = max(row + 1, int(np.searchsorted(sizes, used + SLICE, side="right")))
                part = batch.slice(row, end - row)
                h1, h2, h3, h4 = (part.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))
                made = cut(part.column("_text"), h1, h2, h3 % 100 >= rate, h4 % 100 < spm, sentinels, unit)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f"k{i}") for i in range(len(keep))], *made], names=[*[f"k{i}" for i in range(len(keep))], *RESULT]
                )
                row = end

    return rows.mapInArrow(run, schema).toDF(*keep, *RESULT)


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made from; a column expression."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    joined = lambda *places: let(parts, lambda p: F.concat(*[F.get(p, F.lit(i)) for i in places]))
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
