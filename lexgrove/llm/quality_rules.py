"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule rejects a whole text. On a documented sample (about ``SAMPLE`` rows) every
rule is run on every text by itself: its mean time is its cost, the share it rejects
its selectivity. The cascade then runs the rules in the order of rejections per
second and stops at the first that rejects, so most rejected texts never meet the
dear rules. The order changes the work only: a text is kept if no rule rejects it.

Defined cases: a null or empty text has no words, and so fails; repeated rows get
equal verdicts; an empty table gives an empty result (and the rules' listed order);
further columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import ship_package

SAMPLE = 2000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
_LATIN = re.compile(rb"[A-Za-z]")


class Text:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        if name not in _COUNTS:
            raise AttributeError(name)
        value = _COUNTS[name](self)
        self.__dict__[name] = value
        return value


def _words(t: Text) -> list[bytes]:
    return t.text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only


def _lines(t: Text) -> list[str]:
    return [line for line in t.text.split("\n") if line.strip(SPACES)]


def _repeated(t: Text) -> int:
    """Words in windows of ``WINDOW`` words that are found twice or more: windows are named by
    ranking pairs of half as long windows, so equal names mean equal words."""
    n, known = len(t.words), {}
    if n <= WINDOW:
        return 0
    name = np.fromiter((known.setdefault(w, len(known)) for w in t.words), np.int64, n)
    if len(known) == n:
        return 0
    for step in (1, 2, 4):
        pair = name[:-step] * (int(name.max()) + 1) + name[step:]
        found, name = np.unique(pair, return_inverse=True)
        if len(found) == len(pair):
            return 0
    again = np.flatnonzero(np.bincount(name)[name] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[again] += 1
    edges[again + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _lettered(t: Text) -> int:
    return sum(
        1 for w in t.words
        if w.isalpha() or _LATIN.search(w) or (not w.isascii() and any(map(str.isalpha, w.decode("utf-8", "replace"))))
    )


_COUNTS: dict[str, Callable[[Text], object]] = {
    "words": _words,
    "lines": _lines,
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, SPACES)),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": _repeated,
    "n_lettered": _lettered,
}

#: Rules in their listed order; each says whether it rejects a text.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 20,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 4 * len(t.lines),
    "word_length": lambda t: t.word_chars > 15 * t.n_words or t.word_chars < 2 * t.n_words,
    "few_letters": lambda t: 10 * t.n_lettered < 7 * t.n_words,
}
BASE_RULES = ("few_words", "repeated_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def profile(docs: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """``{rule: (seconds a text, share rejected)}`` on about ``sample`` rows of ``docs(text)``."""
    ship_package(docs.sparkSession)
    total = docs.count()
    chosen = docs.select(F.col("`text`").cast("string").alias("text")).sample(min(1.0, sample / max(total, 1)), seed=11)

    def run(batches):
        seconds, rejected, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for rule, rejects in RULES.items():
                    alone = Text(text)  # counts that rules share are paid by each, as if it came first
                    start = time.perf_counter()
                    rejected[rule] += rejects(alone)
                    seconds[rule] += time.perf_counter() - start
        yield pa.RecordBatch.from_pylist(
            [{"rule": r, "n": n, "seconds": seconds[r], "rejected": rejected[r]} for r in RULES],
        )

    schema = "rule string, n long, seconds double, rejected long"
    sums = chosen.mapInArrow(run, schema).groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("n", "seconds", "rejected")])
    return {r["rule"]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in sums.collect() if r["n"]}


def order_of(profiled: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first; ties and unmeasured rules in their listed order."""
    gain = lambda r: -profiled[r][1] / max(profiled[r][0], 1e-9) if r in profiled else 0.0
    return sorted(RULES, key=gain)


def cascade(docs: DataFrame, order: list[str], *keep: str, counts: bool = False) -> DataFrame:
    """``keep``, ``kept`` and ``failed_rule`` (the first in ``order`` that rejects) of every row; no shuffle.

    With ``counts`` also the base counts and ``base_failed``, computed for every text after its verdict.
    """
    ship_package(docs.sparkSession)
    keep = keep or ("doc_id",)
    narrow = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("`text`").cast("string").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    more = [f"{c} long" for c in BASE] + ["base_failed boolean"] if counts else []
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["kept boolean, failed_rule string"] + more)

    def run(batches):
        rules = [(name, RULES[name]) for name in order]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                table = pa.Table.from_batches([batch.slice(at, 512)])
                failed, counted = [], []
                for value in table.column("_text").to_pylist():
                    text = Text(value)
                    failed.append(next((name for name, rejects in rules if rejects(text)), None))
                    if counts:
                        base = [getattr(text, c) for c in BASE]
                        counted.append((*base, any(RULES[r](text) for r in BASE_RULES)))
                out = table.select(list(keep)).append_column("kept", pa.array([f is None for f in failed], pa.bool_()))
                out = out.append_column("failed_rule", pa.array(failed, pa.string()))
                for i, c in enumerate(BASE if counts else ()):
                    out = out.append_column(c, pa.array([row[i] for row in counted], pa.int64()))
                if counts:
                    out = out.append_column("base_failed", pa.array([row[-1] for row in counted], pa.bool_()))
                yield from out.to_batches()

    return narrow.mapInArrow(run, schema)


def judged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Verdicts and base counts of every row of ``docs(doc_id, text)``."""
    return cascade(docs, order_of(profile(docs, sample)), "doc_id", counts=True)
