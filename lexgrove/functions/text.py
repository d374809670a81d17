"""Column helpers for text: patterns, trimming, casing, dates, templates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python treats as white space at the ends of a string.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A noncharacter marks cut positions; see ``_mark`` for texts that hold it.
CUT = "\uffff"


# The letter with which a match begins, unless it is repeated or stands behind more than opening brackets.
_FIRST_LETTER = re.compile(r"((?:\(\?:|\((?!\?))*)([A-Za-z])(?![?*+{])")


def rx(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Flags that make Java read ``pattern`` with Unicode classes and ``\\n`` lines.

    Where case is ignored, a first letter is written as a class: the same matches, but Java looks
    for it in a table instead of folding every character of the text.
    """
    if ignore_case:
        pattern = _FIRST_LETTER.sub(r"\1[\2]", pattern, count=1) if _FIRST_LETTER.match(pattern) else pattern
    return "(?dU" + ("iu" if ignore_case else "") + ("s" if dot_all else "") + ")" + pattern


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, combine) -> Column:
    """Inclusive running fold of an array: element i is ``combine`` over elements 0 to i.

    The array is folded in blocks, and the blocks' results are folded in front, so that no array
    longer than a block is regrown element by element: n elements cost about n ** (4 / 3) copies.
    ``combine`` is evaluated twice a step and should be cheap.
    """

    def scan(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("last"), F.slice(F.array(start), 1, 0).alias("all"))

        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(items, first, step, lambda acc: acc["all"])

    def by_blocks(whole: Column) -> Column:
        block = F.greatest(F.lit(16), F.ceil(F.cbrt(2.0 * F.size(whole))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), block)
        sums = scan(F.transform(starts, lambda at: F.aggregate(F.slice(whole, at, block), zero, combine)), zero)
        before = lambda s, i: F.when(i > 0, F.get(s, i - 1)).otherwise(zero)
        return let(sums, lambda s: F.flatten(F.transform(starts, lambda at, i: scan(F.slice(whole, at, block), before(s, i)))))

    return let(values, by_blocks)


def count_below(sorted_values: Column, value: Column) -> Column:
    """How many elements of an ascending array are below ``value``; by binary search."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        right = (acc["low"] < acc["high"]) & (F.get(sorted_values, mid) < value)
        return F.struct(
            F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(mid).alias("high")
        )

    n = F.size(sorted_values)
    whole = F.struct(F.lit(0).alias("low"), n.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), whole, halve, lambda acc: acc["low"])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    """'' (or only blanks) becomes null; other values keep their blanks."""
    return F.when(strip(c) != "", c)


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(strip(null_to_blank(c)), rx(r"\s+"), " ")


def first_group(text: Column, patterns: Sequence[str], group: int = 1, **flags) -> Column:
    """Group of the first pattern that matches; null if none does."""
    return F.coalesce(
        *[let(F.regexp_extract(text, rx(p, **flags), group), lambda found: F.when(found != "", found)) for p in patterns]
    )


def iso_date(text: Column, pattern: str, **flags) -> Column:
    """``yyyy-mm-dd`` from a pattern whose groups are day, month, year; null if absent.

    The text is scanned once; the parts are taken from the matched piece.
    """
    java = rx(pattern, **flags)

    def iso(piece: Column) -> Column:
        year = F.nullif(F.regexp_extract(piece, java, 3), F.lit(""))
        month = F.lpad(F.regexp_extract(piece, java, 2), 2, "0")
        day = F.lpad(F.regexp_extract(piece, java, 1), 2, "0")
        return F.concat(year, F.lit("-"), month, F.lit("-"), day)

    return let(F.regexp_extract(text, java, 0), iso)


def _mark(text: Column) -> Column:
    """A string that the text does not hold: the cut character or, if that is in it, one with checksums of the text."""
    own = F.concat(F.lit(CUT), F.crc32(text).cast("string"), F.abs(F.xxhash64(text)).cast("string"), F.lit(CUT))
    return F.when(F.contains(text, F.lit(CUT)), own).otherwise(F.lit(CUT))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, not only after a blank."""

    def cased(text: Column) -> Column:
        gap = F.concat(_mark(text), F.lit(" "))
        opened = F.regexp_replace(F.lower(text), F.lit(r"([^\p{L}\p{M} ])"), F.concat(F.lit("$1"), gap))
        return F.replace(F.initcap(opened), gap, F.lit(""))

    return let(c, cased)


def any_contains(c: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def first_rule(rules: Sequence[tuple[Column, object]], otherwise) -> Column:
    """``when`` chain: value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise)


def cut_at(text: Column, pattern: str, **flags) -> Column:
    """Array of pieces, cut in front of every match (the match stays in its piece).

    The first element is the text before the first match and may be empty.
    """

    java = rx("(?:" + pattern + ")", **flags)

    def cut(whole: Column) -> Column:
        def at_marks(mark: Column) -> Column:
            return F.split(F.regexp_replace(whole, F.lit(java), F.concat(mark, F.lit("$0"))), mark)

        # most texts have no match and are not written anew
        return F.when(~whole.rlike(java), F.array(whole)).otherwise(let(_mark(whole), at_marks))

    return let(text, cut)


def fill(template: str, **values: Column) -> Column:
    """Concatenation of a ``{name}`` template with columns; nulls become ''."""
    parts = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(null_to_blank(values[name].cast("string")))
    return F.concat(*parts)


def snippet(c: Column, max_chars: int) -> Column:
    """First ``max_chars`` of the blank-collapsed text, ``...`` if it was longer."""
    clean = collapse_blanks(c)
    return F.when(
        F.length(clean) > max_chars, F.concat(rstrip(head(clean, max_chars)), F.lit("..."))
    ).otherwise(clean)


def drop_page_lines(
    text: Column, line_patterns: Sequence[str], note_prefix: str | None = None
) -> Column:
    """Remove page-number and layout-note lines, then trim."""
    # an anchor that all patterns have stands in front of the choice, so that a line is tried at its start only
    anchored = all(p.startswith("^") and "|" not in re.sub(r"\([^()]*\)", "", p) for p in line_patterns)
    choice = "|".join(f"(?:{p[1:] if anchored else p})" for p in line_patterns)
    noise = rx(f"{'^' if anchored else ''}(?:{choice})", ignore_case=True)

    def kept(line: Column) -> Column:
        def of_text(bare: Column) -> Column:
            drop = bare.rlike(noise)
            if note_prefix:
                drop = drop | bare.startswith(note_prefix)
            return ~drop

        return let(strip(line), of_text)

    return strip(F.array_join(F.filter(F.split(text, "\n"), kept), "\n"))
