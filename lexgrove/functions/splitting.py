"""Recursive size split of a text column into overlapping chunks.

Three steps, all column expressions (no shuffle, no Python worker):

* cut the text at separators of decreasing strength; only pieces that are still
  too long are cut again by the next separator;
* a piece taken out of a too-long parent opens a new run, so that its parts are
  never packed together with the parent's neighbours;
* pack the pieces of a run greedily up to ``size`` characters; each chunk after
  the first starts with the last whole pieces of the one before, up to
  ``overlap`` characters.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions.text import count_below, cut_at, let, running, rx, strip


def _piece(text: Column, opens: Column) -> Column:
    return F.struct(text.alias("text"), opens.alias("opens"))


def _cut_long(pieces: Column, separator: str, size: int, step: int, flags: dict) -> Column:
    """Cut the pieces of ``size`` or more characters at ``separator``; at none, every ``step`` characters."""

    def cut(piece: Column) -> Column:
        text = piece["text"]
        if separator == "":
            parts = F.regexp_extract_all(text, F.lit(rx(f".{{1,{step}}}", dot_all=True)), 0)
        else:
            parts = cut_at(text, separator, **flags)
        parts = F.filter(parts, lambda p: p != "")
        # the first part of a cut piece opens a run; the others belong to it
        fresh = F.transform(parts, lambda p, i: _piece(p, i == 0))
        return F.when(F.length(text) >= size, fresh).otherwise(F.array(piece))

    return F.flatten(F.transform(pieces, cut))


def _mark_runs(pieces: Column, size: int) -> Column:
    """The piece that follows a still too-long piece opens a run as well."""

    def marked(all_pieces: Column) -> Column:
        def mark(piece: Column, i: Column) -> Column:
            before = F.get(all_pieces, i - 1)["text"]
            after_long = F.coalesce(F.length(before) >= size, F.lit(False))
            return _piece(piece["text"], piece["opens"] | after_long)

        return F.transform(all_pieces, mark)

    return let(pieces, marked)


def pieces_of(text: Column, separators: Sequence[str], size: int, overlap: int = 1, **flags) -> Column:
    """Array of ``struct(text, opens)`` whose texts concatenate to ``text``.

    Text without any separator is cut every ``gcd(size, overlap)`` characters: packing
    then gives the same chunks as with single characters, from far fewer pieces.

    A level's pieces are grouped by the parent they came from: after cutting,
    the sibling that follows a long piece opens a new run (``_mark_runs``).
    """
    pieces = F.array(_piece(text, F.lit(True)))
    for level, separator in enumerate(separators):
        if level == 0:
            # the whole text is always cut by the strongest separator present
            parts = F.filter(cut_at(text, separator, **flags), lambda p: p != "")
            pieces = F.transform(parts, lambda p: _piece(p, F.lit(False)))
        else:
            pieces = _cut_long(_mark_runs(pieces, size), separator, size, gcd(size, overlap), flags)
    return _mark_runs(pieces, size)


def _spans(edges: Column, opens: Column, size: int, overlap: int) -> Column:
    """``struct(first, after)`` of the pieces of every chunk: the first piece and the one behind the last.

    ``edges`` are the running lengths of the pieces, ``opens`` the places that open a run. A chunk's end
    and the tail it carries over are found in them by binary search; the pieces are not visited.
    """
    n = F.size(edges)
    edge = lambda i: F.when(i > 0, F.get(edges, i - 1)).otherwise(F.lit(0).cast("long"))

    def tail(at: Column) -> Column:
        """First of the whole pieces before ``at`` that are carried over: within the overlap, leaving room for the next."""
        room = F.least(F.lit(overlap), F.lit(size) - (edge(at + 1) - edge(at)))
        reaches = edge(at) - room
        first = F.when(reaches > 0, count_below(edges, reaches) + 1).otherwise(F.lit(0))
        opening = F.coalesce(F.get(opens, count_below(opens, at)) == at, F.lit(False))
        return F.when(opening, at).otherwise(F.least(at, first))

    def chunk(acc: Column) -> Column:
        run_end = F.coalesce(F.get(opens, count_below(opens, acc["at"] + 1)), n)
        full = count_below(edges, edge(acc["first"]) + size + 1)
        after = F.greatest(acc["at"] + 1, F.least(run_end, full))
        return let(after, lambda at: F.struct(
            at.alias("at"), tail(at).alias("first"),
            F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), at.alias("after")))).alias("out"),
        ))

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,after:int>>").alias("out")
    )
    # Two chunks of a run that follow each other have more than ``size - overlap`` new characters, so there are
    # far fewer steps than pieces. (An array that grows step by step is copied at each.)
    most = n.cast("long")
    if size > overlap:
        most = F.least(most, F.floor(edge(n) * 2 / (size - overlap)) + F.size(opens) * 2 + 4)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")), start,
        lambda acc, _: F.when(acc["at"] < n, chunk(acc)).otherwise(acc), lambda acc: acc["out"],
    )


def pack(pieces: Column, size: int, overlap: int) -> Column:
    """Greedy packing of ``struct(text, opens)`` pieces into chunk texts."""

    def packed(held: Column) -> Column:
        lengths = F.transform(held, lambda p: F.length(p["text"]).cast("long"))
        opens = F.filter(F.transform(held, lambda p, i: F.when(p["opens"], i)), lambda i: i.isNotNull())
        places = F.struct(
            running(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("edges"), opens.alias("opens"),
            held["text"].alias("texts"),
        )
        chunks = let(places, lambda h: F.transform(
            _spans(h["edges"], h["opens"], size, overlap),
            lambda s: strip(F.array_join(F.slice(h["texts"], s["first"] + 1, s["after"] - s["first"]), "")),
        ))
        return F.filter(chunks, lambda chunk: chunk != "")

    return let(pieces, packed)


def split_text(
    text: Column, separators: Sequence[str], size: int, overlap: int, **flags
) -> Column:
    """Array of trimmed, non-empty chunks of ``text`` in order."""
    return pack(pieces_of(text, separators, size, overlap, **flags), size, overlap)
