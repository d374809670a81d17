"""Fill-in-the-middle, ranked lexical search and the license scan against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.llm import fill_middle, lexical_search, license_scan, words
from lexgrove.llm.license_scan import Automaton, parsed

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


# fill in the middle


def filled(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hex_ = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hex_[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_filled(docs, **how):
    made = fill_middle.transformed(docs, "doc_id", "text", **how)
    rows = made.withColumn("back", fill_middle.restored("output", "form")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[2:7]) == filled(r.doc_id, r.text, **how)
        assert r.back == (r.text or "")


def test_fill_in_the_middle(spark, documents, edge, nothing):
    check_filled(documents)
    check_filled(edge)
    check_filled(edge, seed=3, rate=60, spm=20)
    assert fill_middle.transformed(nothing, "doc_id").collect() == []
    with pytest.raises(ValueError):
        fill_middle.transformed(documents.withColumn("n", F.lit(1)), "doc_id", "n")
    assert fill_middle.transformed(documents.withColumn("n", F.lit(1)), "doc_id").count() == documents.count()


def test_fill_in_the_middle_of_odd_texts(spark, monkeypatch):
    random.seed(5)
    odd = ["\n", "\n\n\n", "a", "a\n", "\na", "x<P>y\nz\n", "<M>", "<P", "é\n😀😀\nß", "\r\n\r\n", "\x00\n\x00", "\x8a\n\x0b" * 9, "nul\x00"]
    odd += ["".join(random.choice("ab\né😀中 ") for _ in range(random.randrange(60))) for _ in range(300)]
    odd += ["é中😀\n" * 40_000 + "end", "unbroken" * 50_000, None, ""]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    check_filled(docs)
    check_filled(docs.repartition(1))  # all in one slice


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: b.replace(b"\r", b"\n")), min_size=1, max_size=6))
def test_marks_rank_and_select(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    for found, marks in (
        (data == 10, fill_middle.ends(fill_middle._words(data), 10)), ((data & 0xC0) != 0x80, fill_middle.starts(fill_middle._words(data)))
    ):
        m = fill_middle.Marks(marks)
        at = np.arange(len(data) + 1)
        assert m.rank(at).tolist() == [0, *np.cumsum(found).tolist()]
        k = np.arange(1, int(found.sum()) + 1)
        assert m.select(k).tolist() == (np.flatnonzero(found) + 1).tolist()


# words


def test_words_in_parts(monkeypatch):
    text = "Ab, cÉd\x00_9é" + "x" * 50 + "  ß-Ñ " * 9
    for part in (1, 3, 7, 1000):
        listed = [w.decode() for p in words.word_parts(text, part) for w in p]
        assert listed == terms(text)
    assert list(words.word_parts(None)) == []


# ranked lexical search


def search(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 100 - 90 + (90 * n * total) // length
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def check_search(docs, items, **how):
    rows = lexical_search.ranked(docs, items, **how).collect()
    expected = search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], **how)
    assert Counter(map(tuple, rows)) == Counter(expected)


@pytest.fixture(scope="module")
def items(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def test_search(documents, items):
    check_search(documents, items)
    check_search(documents.repartition(7), items, k=3)


def test_search_in_small_tiles_and_blocks(documents, items, monkeypatch):
    for name, value in (("ITEMS", 7), ("TERMS", 300)):
        monkeypatch.setattr(lexical_search, name, value)
    check_search(documents, items.limit(12))


def test_search_of_awkward_tables(spark, edge, nothing, items):
    asked = spark.createDataFrame(
        [(1, "alpha THETA 4785380592391139"), (1, "fox"), (2, None), (None, "è ü beta"), (3, ""), (4, "absent"), (5, "the quick brown, fox!")],
        "item_id long, text string",
    ).withColumn("score", F.lit("mine")).withColumn("pos", F.lit(0))
    check_search(edge, asked)
    check_search(edge, asked, k=1)
    assert lexical_search.ranked(nothing, asked).collect() == []
    assert lexical_search.ranked(edge, asked.limit(0)).collect() == []
    assert lexical_search.ranked(edge, asked.where("text is null")).columns == ["item_id", "rank", "doc_id", "score"]
    copies = spark.createDataFrame([(i, "same words here") for i in range(500, 0, -1)], "doc_id long, text string")
    check_search(copies.repartition(4), asked.withColumn("text", F.lit("words")))


def test_tile_sums_stay_exact():
    n, counts = np.array([1, 5, 10_000, 3]), np.array([1, 5, 9_999, 1])
    held = lexical_search.impacts(n, counts, 4, 10_009)
    assert (held < lexical_search.IMPACT).all()
    most = lexical_search.weight(10**12, 0)
    assert lexical_search.TILE_TERMS * most * lexical_search.IMPACT < 2**53  # at a trillion documents still


def test_best_keeps_equals_by_document():
    best = lexical_search.Best(2, 3)
    for docs, scores in (([9, 8], [[5, 0], [5, 1]]), ([1, 2], [[5, 1], [4, 1]]), ([3, 0], [[5, 1], [5, 9]])):
        best.add(np.array(scores), np.array(docs), np.zeros(2, bool))
    got = sorted(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist()))
    assert got == [(0, -5, 0), (0, -5, 1), (0, -5, 3), (1, -9, 0), (1, -1, 1), (1, -1, 2)]


# license scan


def as_pattern(items):
    out = ""
    for i in items:
        if isinstance(i, bytes):
            out += re.escape(i.decode()) + " "
        elif i[0] == "any":
            out += r"(?:\S+ ){%d,%d}" % i[1:]
        else:
            out += f"(?:{as_pattern(i[1])})?"
    return out


def scan_by_pattern(text, phrases, templates):
    """Every place by trying a pattern at every word."""
    w = terms(text)
    joined, starts = " ".join(w) + " ", np.concatenate(([0], np.cumsum([len(x) + 1 for x in w]))).astype(int)
    found = set()
    for base, named in ((True, phrases), (False, templates)):
        for label, texts in named.items():
            for t in texts:
                p = re.compile(as_pattern(parsed(t)))
                found |= {(label, base, i) for i in range(len(w)) if p.match(joined, starts[i])}
    return len(w), found


PH = {"one": ["a b"], "two": ["b a b", "c"]}
TP = {
    "X": ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"],
    "Y": ["b <<var;words=1-3>> d", "d <<var;words=0-2>> a <<beginOptional>>a<<endOptional>> c"],
    "Z": ["<<beginOptional>>c<<endOptional>> b b"],
}


def test_automaton_equals_patterns(monkeypatch):
    random.seed(3)
    monkeypatch.setattr(license_scan, "REMEMBERED", 12)
    automaton = Automaton(PH, TP)
    for _ in range(400):
        text = " ".join(random.choice("abcdABCDe.") for _ in range(random.randrange(60)))
        n, found = automaton.scan(text)
        kinds = automaton.wordings
        assert (n, {(kinds[w].label, kinds[w].base, a) for w, a, _ in found}) == scan_by_pattern(text, PH, TP)


def test_seams_lose_no_match(monkeypatch):
    random.seed(4)
    monkeypatch.setattr(license_scan, "word_parts", lambda text: words.word_parts(text, 5))
    automaton = Automaton(PH, TP)
    for _ in range(200):
        text = " ".join(random.choice("abcde") for _ in range(random.randrange(80)))
        n, found = automaton.scan(text)
        kinds = automaton.wordings
        assert (n, {(kinds[w].label, kinds[w].base, a) for w, a, _ in found}) == scan_by_pattern(text, PH, TP)


@pytest.mark.parametrize("wrong", ["<<var;words=1-2>> a", "a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", "a <<var;words=3-1>> b", "a <<else>> b"])
def test_wrong_markup_is_refused(wrong):
    with pytest.raises(ValueError):
        Automaton({}, {"L": [wrong]})


def test_license_texts(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof {} and associated documentation files (the"
        ' "Software"), to deal in the\nSoftware without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell\n * copies of the Software, and to permit persons to whom the Software is furnished"
        " to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice{} shall be included in"
        " all copies or substantial portions of the Software."
    )
    cases = [
        (mit.format("this software", ""), "MIT"),
        (mit.format("this very own software of ours", " (including the next paragraph)").upper(), "MIT"),
        (mit.format("this software", "").replace("free of charge", "for a charge"), ""),
        (mit.format("one two three four five six seven eight nine", ""), ""),  # the replaceable region has a bound
        ("Licensed under the Apache License, Version 2.0 (the License)", "Apache-2.0,apache"),
        ("licensed under the Apache License", "apache"),
        ("GNU General Public License as published by the Free Software Foundation, either version 3", "GPL-3.0,gpl"),
        ("GNU Lesser General Public License", "LGPL,gpl"),
        ("Released under the MIT-License", "MIT,mit"),
        ("the mit\nlicenses", ""),
        ("Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ]
    docs = spark.createDataFrame([(i, t, "extra") for i, (t, _) in enumerate(cases)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    assert [got[i].labels for i in range(len(cases))] == [e for _, e in cases]
    assert got[5].n_base == 1 and got[5].first_word == got[5].last_word == 3 and got[5].score == pytest.approx(2 / 3)
    found = license_scan.places(docs).where("doc_id = 4").orderBy("base", "start").collect()
    assert [(r.label, r.base, r.start, r.end) for r in found] == [
        ("Apache-2.0", False, 0, 8), ("Apache-2.0", False, 3, 8), ("apache", True, 3, 5)
    ]


def test_license_scan_of_awkward_rows(edge, nothing, documents):
    assert license_scan.scanned(nothing).collect() == []
    rows = license_scan.scanned(edge, "doc_id", "text").collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r.n_words == len(terms(r.text))
        assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, None, None, "", "", 0.0)
    for r in license_scan.scanned(documents, "doc_id", "text").collect():
        w = terms(r.text)
        starts = [i for p in ("mit license", "apache license", "general public license") for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), min(starts, default=None), max(starts, default=None))
