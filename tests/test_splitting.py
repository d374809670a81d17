"""Column-based splitting against a direct recursive splitter on small texts."""

import random
import re

from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions import text
from lexgrove.functions.splitting import pieces_of, split_text
from lexgrove.operators.chunking import marker_chunks, packed_chunks

SEPARATORS = [r"Điều \d", r"\n\n", r"\n", r"\. ", r" "]


def merge(parts, size, overlap):
    chunks, window = [], []
    for part in parts:
        if window and sum(map(len, window)) + len(part) > size:
            chunks.append("".join(window))
            while window and (
                sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size
            ):
                window = window[1:]
        window = window + [part]
    return chunks + ["".join(window)]


def brute(text, separators, size, overlap):
    """Cut by the first separator that occurs; recurse into what is still long."""
    present = [i for i, s in enumerate(separators) if re.search(s, text)]
    if not present:
        return [text.strip()]
    at = present[0]
    starts = [m.start() for m in re.finditer(separators[at], text)]
    edges = sorted({0, *starts, len(text)})
    parts = [text[a:b] for a, b in zip(edges, edges[1:])]
    out, run = [], []
    for part in parts + [None]:
        if part is not None and len(part) < size:
            run.append(part)
            continue
        if run:
            out += merge(run, size, overlap)
            run = []
        if part is not None:
            out += brute(part, separators[at + 1 :], size, overlap)
    return [c.strip() for c in out if c.strip()]


def random_text(rng):
    words = ["a", "của", "quyền", "sở", "hữu.", "trí", "tuệ", "xxxxxxxxxxxxxxxxxxxxxxxxx"]
    out = []
    for _ in range(rng.randint(0, 60)):
        out.append(rng.choice(words))
        out.append(rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\nĐiều 1. ", "\n\n\n", "  "]))
    return "".join(out)


def test_split_equals_recursive_splitter(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for size, overlap in ((20, 0), (30, 8), (60, 15)):
        rows = df.select("i", split_text(F.col("text"), SEPARATORS, size, overlap).alias("c"))
        got = {r["i"]: r["c"] for r in rows.collect()}
        for i, text in enumerate(texts):
            expected = brute(text, SEPARATORS, size, overlap) if text else []
            assert got[i] == expected, (size, overlap, text)


def test_pieces_restore_the_text(spark):
    rng = random.Random(6)
    texts = [random_text(rng) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    joined = F.array_join(F.transform(pieces_of(F.col("text"), SEPARATORS, 20), lambda p: p["text"]), "")
    assert df.where(joined != F.col("text")).count() == 0


def test_whole_documents_keep_all_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    chunks = packed_chunks(docs, "doc_id", "text", size=500, overlap=0)
    assert chunks.agg(F.max(F.length("content"))).first()[0] <= 500
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    joined = chunks.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda r: r["content"]),
            "",
        ).alias("joined")
    )
    lost = docs.join(joined, "doc_id", "left").where(
        bare != F.coalesce(F.regexp_replace("joined", r"(?U)\s+", ""), F.lit(""))
    )
    assert lost.count() == 0


def test_chunk_ids_are_unique_and_stable(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chunks = packed_chunks(docs, "doc_id", "text")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    again = packed_chunks(docs.repartition(7), "doc_id", "text")
    assert chunks.select("chunk_id").exceptAll(again.select("chunk_id")).count() == 0


def test_marker_chunks_intro(spark):
    df = spark.createDataFrame([(1, "intro text\n[1] one\n[2] two"), (2, "ab\n[1] x")], "id int, t string")
    rows = marker_chunks(df, "id", "t", fv.POINT_MARKER, intro_chars=5).collect()
    got = {(r["id"], r["chunk_index"]): r["content"] for r in rows}
    assert got == {(1, 0): "intro text", (1, 1): "[1] one", (1, 2): "[2] two", (2, 0): "[1] x"}


def test_texts_that_hold_the_cut_character(spark):
    df = spark.createDataFrame([("ab\uffffcd; ef",), ("\uffff;\uffff \uffff x",), ("plain; text",)], "t string")
    rows = df.select("t", text.cut_at(F.col("t"), ";").alias("p"), text.title_case(F.col("t")).alias("c")).collect()
    assert all("".join(r["p"]) == r["t"] and len(r["p"]) == 2 and r["p"][1][0] == ";" for r in rows)
    assert rows[0]["c"] == "Ab\uffffCd; Ef" and rows[2]["c"] == "Plain; Text"


def test_unbroken_text_is_cut_as_by_single_characters(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcxyzé𝄞") for _ in range(n))
    texts = [word(n) for n in (1, 19, 20, 21, 40, 97, 400)] + [f"{word(5)} {word(75)} {word(3)} {word(44)}" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((20, 0), (20, 4), (30, 12), (25, 7)):
        rows = df.select("i", split_text(F.col("text"), [r" ", ""], size, overlap).alias("c"))
        got = {r["i"]: r["c"] for r in rows.collect()}
        for i, whole in enumerate(texts):
            expected, run = [], []
            edges = sorted({0, *(m.start() for m in re.finditer(" ", whole)), len(whole)})
            for part in [whole[a:b] for a, b in zip(edges, edges[1:])] + [None]:
                if part is not None and len(part) < size:
                    run.append(part)
                    continue
                expected += merge(run, size, overlap) if run else []
                run = []
                expected += merge(list(part), size, overlap) if part is not None else []
            assert got[i] == [c.strip() for c in expected if c.strip()], (size, overlap, whole)


def test_running_folds_and_binary_search(spark):
    rng = random.Random(2)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 15, 16, 17, 33, 300, 5000)]
    df = spark.createDataFrame(rows, "v array<long>")
    zero = F.lit(0).cast("long")
    sums = text.running(F.col("v"), zero, lambda a, x: a + x)
    tops = text.running(F.col("v"), zero, lambda a, x: F.greatest(a, x))
    got = df.select("v", sums.alias("s"), tops.alias("t")).withColumn(
        "below", F.transform(F.sequence(F.lit(-1), F.lit(60)), lambda x: text.count_below(F.col("s"), x))
    )
    for r in got.collect():
        total = top = 0
        expected, highest = [], []
        for x in r["v"]:
            total, top = total + x, max(top, x)
            expected.append(total)
            highest.append(top)
        assert r["s"] == expected and r["t"] == highest
        assert r["below"] == [sum(s < x for s in expected) for x in range(-1, 61)]


def test_many_pieces_of_one_document(spark):
    """A document of 60,000 words and one of unbroken text: same chunks as by hand, in one row each."""
    words, unbroken = "ab " * 60_000, "x" * 300_000
    df = spark.createDataFrame([(0, words), (1, unbroken)], "i int, text string")
    rows = df.select("i", split_text(F.col("text"), [r"\n\n", r" ", ""], 4000, 200).alias("c")).collect()
    got = {r["i"]: r["c"] for r in rows}
    parts = [words[a:b] for a, b in zip([0, *range(2, len(words), 3)], [*range(2, len(words), 3), len(words)])]
    assert got[0] == [c.strip() for c in merge(parts, 4000, 200)]
    assert "".join([got[1][0]] + [c[200:] for c in got[1][1:]]) == unbroken and max(map(len, got[1])) == 4000
