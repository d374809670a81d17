"""Language model, language identification, quality rules, secrets."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import language_id, lm_scoring, quality_rules, secret_scan
from lexgrove.llm.elias_fano import EliasFano, TrieLevel

END = "\n"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_elias_fano():
    rng = np.random.default_rng(2)
    crowded = np.concatenate((rng.integers(0, 9000, 3000), rng.integers(0, 1 << 50, 400)))  # many share a high part
    for n, top in ((0, 1), (1, 1), (7, 3), (500, 20), (2000, 1 << 60), (3400, 1 << 50)):
        values = np.sort((crowded if n == 3400 else rng.integers(0, top, n)).astype(np.uint64))
        made = EliasFano(values)
        assert (made.get(np.arange(n)) == values).all()
        asked = np.concatenate((values, rng.integers(0, top + 9, 300).astype(np.uint64), np.arange(9000, dtype=np.uint64)))
        place, equal = made.successor(asked)
        assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_level(tmp_path):
    rng = np.random.default_rng(4)
    pairs = np.unique(np.stack((rng.integers(0, 90, 4000) * 3, rng.integers(0, 300, 4000)), 1), axis=0)
    level = TrieLevel(pairs[:, 0], pairs[:, 1], str(tmp_path))
    assert (level.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    asked = np.stack((rng.integers(0, 280, 3000), rng.integers(0, 305, 3000)), 1)
    known = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert level.find(asked[:, 0], asked[:, 1]).tolist() == [known.get(tuple(a), -1) for a in asked.tolist()]
    assert any(tmp_path.iterdir())  # levels are files


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_lm_scores_equal_brute_force(request, table, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 40_000)
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, words(r.text) + [END]) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    one, two, three = Counter(), Counter(), Counter()
    for i, w in rows:
        if not held(i):
            f = [END, *w]
            one.update(w), two.update(zip(f, f[1:])), three.update(zip(f, f[1:], f[2:]))
    total, types, m = sum(one.values()), len(one), lm_scoring.M
    expected = []
    for i, w in rows:
        f, base, score = [END, *w], 0.0, 0.0
        for k in range(1, len(f)):
            p = (one[f[k]] + 0.5) / (total + 0.5 * (types + 1))
            base += math.log10(p)
            p = (two[f[k - 1], f[k]] + m * p) / (one[f[k - 1]] + m)
            if k > 1 and two[f[k - 2], f[k - 1]] >= lm_scoring.DEEP:
                p = (three[f[k - 2], f[k - 1], f[k]] + m * p) / (two[f[k - 2], f[k - 1]] + m)
            score += math.log10(p)
        expected.append((i, held(i), len(w), sum(one[x] > 0 for x in w), total, base, score))
    got = sorted((tuple(r) for r in lm_scoring.scores(docs).collect()), key=repr)
    for a, b in zip(got, sorted(expected, key=repr), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=2e-3, abs=2e-3)


def test_lm_trigrams_of_contexts_seen_once(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    train = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1)
    passage = "one passage that a single training document holds"
    docs = spark.createDataFrame([(train, passage), (held, passage)], "doc_id long, text string")
    scored = {r.doc_id: r for r in lm_scoring.scores(docs).collect()}
    n = len(passage.split()) + 1
    assert scored[held].held_out and scored[held].train_tokens == n
    one = 1.5 / (n + 0.5 * (n + 1))  # every word once, the end too
    two = (1 + 4 * one) / 5
    expected = math.log10(two) + (n - 1) * math.log10((1 + 4 * two) / 5)
    assert scored[held].score == pytest.approx(expected, abs=2e-3)


def test_lm_scores_of_no_rows(nothing):
    assert lm_scoring.scores(nothing).collect() == []


def test_codewords_lie_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.codewords(n)
        apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
        assert min(apart) >= code.shape[1] // 4


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = docs.withColumn("held_out", language_id.held_out())
    said = language_id.identify(marked, language_id.fit(docs), "doc_id", "lang", "held_out").where("held_out")
    right, total = said.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.97 * total and said.where("score < 0 or score > 1").count() == 0


def test_language_of_awkward_rows(edge, nothing, documents):
    rows = language_id.identify(edge, language_id.fit(documents)).collect()
    assert len(rows) == edge.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (3, 4, 7, 8))
    assert by_id[1].lang_pred != "und"
    assert language_id.identify(nothing, language_id.fit(nothing)).collect() == []
    untaught = language_id.identify(edge, language_id.fit(nothing)).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    single = language_id.identify(edge, language_id.fit(documents.withColumn("lang", F.lit("xx")))).collect()
    assert {r.lang_pred for r in single} == {"und", "xx"}


def counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {i + k for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for k in range(8)}
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_quality_counts_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    names = ["doc_id", *quality_rules.BASE, "base_failed"]
    got = sorted(repr(tuple(r)) for r in quality_rules.judged(docs).select(*names).collect())
    expected = []
    for r in docs.select("doc_id", "text").collect():
        c = counts(r.text)
        expected.append(repr((r.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])))
    assert got == sorted(expected)


def test_cascade_order_changes_no_verdict(documents, nothing):
    orders = [list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    kept = [sorted(r.doc_id for r in quality_rules.cascade(documents, o).where("kept").collect()) for o in orders]
    assert kept[0] == kept[1]
    assert quality_rules.order_of({"symbols": (1.0, 0.9), "few_words": (0.1, 0.5)})[:2] == ["few_words", "symbols"]
    assert quality_rules.judged(nothing).collect() == []


def test_cascade_stops_at_the_first_rejection(spark, monkeypatch):
    ran = []
    text = quality_rules.Text("few words ### ###")
    rules = {n: (lambda t, n=n, f=f: ran.append(n) or f(t)) for n, f in quality_rules.RULES.items()}
    next(n for n in ("symbols", "few_words") if rules[n](text))
    assert ran == ["symbols"] and "words" in text.__dict__ and "n_repeat_words" not in text.__dict__


def test_secrets_stay_and_card_numbers_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secret_scan.scanned(docs).collect()
    tokens = [r for r in rows if re.fullmatch("[0-9a-f]{40}", r.candidate)]
    assert len(tokens) >= 10 and all(r.is_secret for r in tokens)
    numbers = [r for r in rows if r.candidate.isdigit()]
    assert len(numbers) >= 20 and not any(r.is_secret for r in numbers)
    whole = {(m[0], r.doc_id) for r in docs.collect() for m in re.finditer(r"\b[0-9a-f]{40}\b", r.text or "")}
    assert {(r.candidate, r.doc_id) for r in tokens} == whole


def test_secrets_of_awkward_rows(edge, nothing):
    rows = secret_scan.scanned(edge).collect()
    assert {r.candidate for r in rows} == {"f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "4785380592391139"}
    assert secret_scan.scanned(nothing).collect() == []
    # without labelled findings nothing is removed
    found = secret_scan.candidates(edge, "doc_id")
    kept = secret_scan.scan(found, secret_scan.words_of(edge), secret_scan.train(found.withColumn("label", F.lit(1)), None))
    assert all(r.is_secret and r.score is None for r in kept.collect())


FORMS = [
    ('PASSWORD="correct-horse-battery"', "correct-horse-battery"),
    ('pwd = "Tr0ub4dor"', "Tr0ub4dor"),
    ('DB_PASSWORD = "p@ss!W0rd!2024"', "p@ss!W0rd!2024"),
    ('{"password": "correcthorsebattery"}', "correcthorsebattery"),
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzzTOPKEY", "wJalrXUtnFEMIK7MDENGbPxRfiCYzzTOPKEY"),
    ("export Api-Key=abcdefgh-ijkl", "abcdefgh-ijkl"),
    ("MYAPP1_TOKEN='two words, one secret'", "two words, one secret"),
    ("private_key: Zm9vYmFyYmF6cXV4MTIzNA==", "Zm9vYmFyYmF6cXV4MTIzNA=="),
    ('{\\"apikey\\": \\"q7-w8-e9-r0\\"}', "q7-w8-e9-r0"),
    ("credential => hunter2hunter!,", "hunter2hunter!"),
    ("https://a.b/c?access_key=abcd!efgh&auth=ijkl!mnop&x=1", "abcd!efgh ijkl!mnop"),
]


def test_secrets_of_ordinary_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    own = [(-1 - i, f"first line\n{text}\nlast line", ".env") for i, (text, _) in enumerate(FORMS)]
    own.append((-99, "free 3f9a77c0d1e25b8846aa and token_count1=abc12345678 and S3_BUCKET=q1w2e3r4t5y6u7", ""))
    rows = secret_scan.scanned(docs.unionByName(spark.createDataFrame(own, docs.schema))).where("doc_id < 0").collect()
    for i, (text, values) in enumerate(FORMS):
        mine = sorted((r for r in rows if r.doc_id == -1 - i), key=lambda r: r.nth)
        assert [r.candidate for r in mine] == (values.split(" ") if "&" in text else [values])
        assert all(r.is_secret for r in mine), text
        assert all(re.search(secret_scan._NAMES, r.before.lower()) for r in mine)
    free = sorted((r for r in rows if r.doc_id == -99), key=lambda r: r.nth)
    assert [r.candidate for r in free] == ["3f9a77c0d1e25b8846aa", "token_count1=abc12345678", "q1w2e3r4t5y6u7"]
    assert free[2].before.endswith("S3_BUCKET=")
    labels = {r.candidate: r.label for r in secret_scan.labelled_findings(spark.createDataFrame(
        [("3f9a77c0d1e25b8846aa", "stands free ", " "), ("4785380592391139", "free ", " "), ("Tr0ub4dor", 'PWD = "', '"')],
        "candidate string, before string, after string")).collect()}
    assert labels == {"4785380592391139": 0, "Tr0ub4dor": 1}


def test_numbers_and_signs_are_no_letters(spark, documents):
    texts = ["½ ① ² ३ ⅷ", "१२ _ 3", "½ a", "漢", "́"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(documents)).collect()}
    assert [said[i] == "und" for i in range(5)] == [True, True, False, False, True]


def test_predictions_equal_plain_counting(documents):
    """The same codes from a dictionary of n-grams, without blocks or buckets summed by Spark."""
    model = language_id.fit(documents, sample=10**6)
    counts = {lang: Counter() for lang in model.languages}
    taught = documents.where(~language_id.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    for r in taught:
        for buckets in language_id.grams(r.text):
            counts[r.lang].update(buckets.tolist())
    table = np.zeros((len(model.languages), language_id.BUCKETS))
    for i, lang in enumerate(model.languages):
        table[i, list(counts[lang])] = list(counts[lang].values())
    plain = language_id.Model(model.languages, table)
    for r in language_id.identify(documents, model, "doc_id", "text").collect():
        lang, score, unclear = plain.predict(r.text)
        assert (r.lang_pred, r.ambiguous) == (lang, unclear) and abs(r.score - score) < 1e-9


def test_long_keys_and_wide_assignments_are_candidates(spark):
    late = "k" * 100 + "7" + "q" * 40
    texts = [f"x {late} y", 'password' + " " * 9 + "=" + " " * 9 + '"correct-horse"', "token" + " " * 40 + '= "far-too-far-away"', "Z" * 200_000 + "9"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.candidate) for r in secret_scan.candidates(docs).collect()}
    assert found == {(0, late), (1, "correct-horse"), (3, texts[3])}
