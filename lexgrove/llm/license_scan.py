"""License scan by template-markup matching.

A template is wording with optional and replaceable regions. All templates are compiled
into one token automaton: a mandatory word is a step on that word, an optional region
may be stepped over, a replaceable region takes a bounded number of any words. The
automaton is made deterministic as it is used, and runs from every word that may begin a
template; it accepts where all mandatory wording stands exactly, in order, with nothing
between that the template does not provide for. Words are runs of ASCII letters and
digits and of all characters beyond ASCII, A-Z in lower case, so punctuation, layout and
capitals do not count. Fixed phrases are templates without regions; their places are the
base columns, and their labels always stay.

``score`` is m / (m + 1), m the number of mandatory words of the longest wording that was
accepted (0: none): short phrases are met by chance more easily than long ones.

Defined cases: a null or empty text has no words, no labels (empty strings), null word
places and score 0; repeated rows are scanned alike; an empty table gives an empty result;
a text of any length is scanned whole, in parts of 4 MB whose seams no match is lost at;
further columns are ignored, under any name; a kept column that has the name of a result
column is refused with ValueError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import ship_package
from lexgrove.llm.license_templates import PHRASES, TEMPLATES
from lexgrove.llm.words import word_parts

RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Deterministic states that are remembered; beyond them all are forgotten and made anew.
REMEMBERED = 50_000
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")


def parsed(template: str) -> list:
    """A template as a list of words (bytes), ``("any", least, most)`` and ``("optional", list)``."""
    levels: list[list] = [[]]

    def words(text: str) -> None:
        for part in word_parts(text):
            levels[-1].extend(part)

    at = 0
    for mark in _MARK.finditer(template):
        words(template[at : mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            levels.append([])
        elif mark[1] == "endOptional":
            if len(levels) == 1:
                raise ValueError(f"no region to end in {template!r}")
            region = levels.pop()
            if region:  # punctuation alone
                levels[-1].append(("optional", region))
        else:
            if int(mark[2]) > int(mark[3]):
                raise ValueError(f"no such number of words in {template!r}")
            levels[-1].append(("any", int(mark[2]), int(mark[3])))
    words(template[at:])
    if len(levels) > 1 or "<<" in _MARK.sub("", template):
        raise ValueError(f"markup does not close in {template!r}")
    return levels[0]


def mandatory(items: list) -> int:
    return sum(isinstance(i, bytes) for i in items)


@dataclass
class Wording:
    """A template of the automaton: its label, number of mandatory words and whether it is a fixed phrase."""

    label: str
    words: int
    base: bool


class Automaton:
    """One automaton for all templates; state 0 of the deterministic form is dead, 1 is the start."""

    def __init__(self, phrases: dict[str, list[str]], templates: dict[str, list[str]]):
        self.wordings: list[Wording] = []
        self.number: dict[bytes, int] = {}
        self._steps: list[dict[int, set[int]]] = []
        self._any: list[set[int]] = []
        self._empty: list[set[int]] = []
        self._accepts: list[int | None] = []
        start = self._state()
        for base, named in ((True, phrases), (False, templates)):
            for label, texts in sorted(named.items()):
                for text in texts:
                    items = parsed(text)
                    if not mandatory(items) or any(isinstance(i, tuple) and i[0] == "any" for i in (items[0], items[-1])):
                        raise ValueError(f"{text!r} begins or ends with any words, or has no mandatory word")
                    end = self._chain(items, start)
                    final = self._state()
                    self._empty[end].add(final)
                    self._accepts[final] = len(self.wordings)
                    self.wordings.append(Wording(label, mandatory(items), base))
        self._start = self._closed({start})
        if any(self._any[s] for s in self._start):
            raise ValueError("a template may begin with any words")
        self._forget()
        #: Longest wording in words: no match reaches further than this.
        self.reach = max((self._longest(parsed(t)) for named in (phrases, templates) for ts in named.values() for t in ts), default=0)
        self.first = np.zeros(len(self.number) + 1, bool)
        self.first[[w for s in self._start for w in self._steps[s]]] = True

    def _state(self) -> int:
        self._steps.append({})
        self._any.append(set())
        self._empty.append(set())
        self._accepts.append(None)
        return len(self._steps) - 1

    def _chain(self, items: list, state: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                after = self._state()
                self._steps[state].setdefault(self.number.setdefault(item, len(self.number) + 1), set()).add(after)
            elif item[0] == "any":
                after = self._state()
                for i in range(item[2]):
                    if i >= item[1]:
                        self._empty[state].add(after)
                    step = self._state()
                    self._any[state].add(step)
                    state = step
                self._empty[state].add(after)
            else:
                after = self._chain(item[1], state)
                self._empty[state].add(after)
            state = after
        return state

    def _longest(self, items: list) -> int:
        return sum(1 if isinstance(i, bytes) else i[2] if i[0] == "any" else self._longest(i[1]) for i in items)

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, new = set(states), list(states)
        while new:
            for s in self._empty[new.pop()]:
                if s not in found:
                    found.add(s)
                    new.append(s)
        return frozenset(found)

    def _forget(self) -> None:
        self._sets: list[frozenset[int]] = [frozenset(), self._start]
        self._names = {s: i for i, s in enumerate(self._sets)}
        self._next: dict[tuple[int, int], int] = {}
        self._ends: list[tuple[int, ...]] = [(), ()]

    def _step(self, state: int, word: int) -> int:
        moved: set[int] = set()
        for s in self._sets[state]:
            moved |= self._steps[s].get(word, set()) | self._any[s]
        closed = self._closed(moved)
        name = self._names.get(closed)
        if name is None:
            name = self._names[closed] = len(self._sets)
            self._sets.append(closed)
            self._ends.append(tuple(a for s in closed if (a := self._accepts[s]) is not None))
        self._next[state, word] = name
        return name

    def matches(self, ids: np.ndarray, until: int) -> list[tuple[int, int, int]]:
        """``(wording, start, end)`` of all accepted places that start before ``until``; of each start and wording the longest."""
        found: list[tuple[int, int, int]] = []
        listed = None
        for start in np.flatnonzero(self.first[ids[:until]]).tolist():
            if listed is None:
                listed = ids.tolist()
            if len(self._sets) > REMEMBERED:
                self._forget()
            state, at, here = 1, start, {}
            while at < len(listed):
                key = (state, listed[at])
                state = self._next.get(key, -1)
                if state < 0:
                    state = self._step(*key)
                if not state:
                    break
                at += 1
                for wording in self._ends[state]:
                    here[wording] = at
            found.extend((wording, start, end) for wording, end in here.items())
        return found

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words and all matches of a whole text, in word places."""
        get, rest, before, found, ids = self.number.get, np.zeros(0, np.int64), 0, [], None
        for words in word_parts(text):
            part = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            ids = np.concatenate((rest, part)) if len(rest) else part
            until = max(0, len(ids) - self.reach + 1)  # later starts may need words of the next part
            found.extend((w, before + a, before + b) for w, a, b in self.matches(ids, until))
            before, rest = before + until, ids[until:]
        found.extend((w, before + a, before + b) for w, a, b in self.matches(rest, len(rest)))
        return before + len(rest), found


def summary(automaton: Automaton, text: str | None) -> tuple:
    """The columns of ``RESULT`` of one text."""
    n, found = automaton.scan(text)
    kinds = automaton.wordings
    base = [start for w, start, _ in found if kinds[w].base]
    most = max((kinds[w].words for w, _, _ in found), default=0)
    joined = [",".join(sorted({kinds[w].label for w, _, _ in found if kinds[w].base or not only})) for only in (True, False)]
    return n, len(base), min(base, default=None), max(base, default=None), *joined, most / (most + 1)


def scanned(
    docs: DataFrame, *keep: str, text: str = "text",
    phrases: dict[str, list[str]] = PHRASES, templates: dict[str, list[str]] = TEMPLATES,
) -> DataFrame:
    """``keep`` and the columns of ``RESULT`` of every row; no shuffle."""
    return _mapped(docs, keep or ("doc_id",), text, phrases, templates, RESULT,
                   "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
                   lambda a, value: [summary(a, value)])


def places(
    docs: DataFrame, *keep: str, text: str = "text",
    phrases: dict[str, list[str]] = PHRASES, templates: dict[str, list[str]] = TEMPLATES,
) -> DataFrame:
    """``keep, label, base, start, end``: one row per accepted place, in words from 0, ``end`` exclusive."""
    def rows(a: Automaton, value):
        return [(a.wordings[w].label, a.wordings[w].base, start, end) for w, start, end in a.scan(value)[1]]

    return _mapped(docs, keep or ("doc_id",), text, phrases, templates, ("label", "base", "start", "end"),
                   "label string, base boolean, start long, end long", rows)


def _mapped(docs, keep, text, phrases, templates, names, types, rows_of) -> DataFrame:
    """``keep`` and ``names`` for every row that ``rows_of(automaton, text)`` gives."""
    ship_package(docs.sparkSession)
    if clash := set(keep) & set(names):
        raise ValueError(f"columns {sorted(clash)} are results")
    Automaton(phrases, templates)  # refuses wrong markup here, not in a task
    numbered = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(f"`{k}`").alias(n) for k, n in zip(keep, numbered)]
    rows = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join([f"{n} {docs.schema[k].dataType.simpleString()}" for k, n in zip(keep, numbered)] + [types])
    fields = docs.sparkSession.createDataFrame([], types).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        automaton, made = Automaton(phrases, templates), to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, out = [], []
                for i, value in enumerate(part.column(len(keep)).to_pylist()):
                    new = rows_of(automaton, value)
                    row.extend([i] * len(new))
                    out.extend(new)
                table = pa.Table.from_batches([part]).select(numbered).take(pa.array(row, pa.int64()))
                for i, field in enumerate(made):
                    table = table.append_column(field.name, pa.array([o[i] for o in out], field.type))
                yield from table.to_batches()

    return rows.mapInArrow(run, schema).toDF(*keep, *names)
