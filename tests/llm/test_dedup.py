"""SimHash, exact and suffix-array de-duplication against brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from lexgrove.llm import exact_dedup, fuse_filter, simhash_dedup, suffix_dedup
from lexgrove.llm.components import components
from lexgrove.llm.suffix_array import _words, permuted_prefixes, suffix_array


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable over at most four differing bits; prints: [(id, fingerprint)]."""
    least = [i for i, _ in prints]
    big = lambda x: float("inf") if x is None else x
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            near = [least[j] for j, (_, b) in enumerate(prints) if (a ^ b).bit_count() <= 4]
            low = min(near, key=big)
            if big(low) < big(least[i]):
                least[i], changed = low, True
    return least


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_simhash_equals_brute_force(request, table):
    docs = request.getfixturevalue(table)
    data = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    expected = sorted(map(repr, ((i, f"{f:016x}", c) for (i, f), c in zip(data, classes(data)))))
    assert sorted(repr(tuple(r)) for r in simhash_dedup.near_duplicates(docs).collect()) == expected


def test_simhash_of_no_rows(nothing):
    assert simhash_dedup.near_duplicates(nothing).collect() == []


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    """Fingerprints that all share two segments, so that every bucket is above the block size."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    prints = sorted({int(x) for x in rng.integers(0, 1 << 12, 300)} | {int(x) << 30 for x in rng.integers(0, 1 << 12, 60)})
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.fp: r.root for r in simhash_dedup.fingerprint_roots(fps).collect()}
    least = classes([(p, p) for p in prints])
    groups = lambda label: {frozenset(p for p in prints if label[p] == x) for x in set(label.values())}
    assert groups({p: roots.get(p, p) for p in prints}) == groups(dict(zip(prints, least)))


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, sizes.values())) == [3, 90, 201]


def test_fuse_filter_misses_nothing_and_passes_few():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        made = fuse_filter.build(keys)
        assert fuse_filter.contains(made, keys).all()
        others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        assert fuse_filter.contains(made, others).mean() < 0.02
    assert len(made) < 1.4 * 50_000


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_exact_equals_brute_force(request, table):
    docs = request.getfixturevalue(table)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    data = [(r.doc_id, digest(r.text)) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for i, d in data:
        groups.setdefault(d, []).append(i)
    expected = []
    for d, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            expected.append((i, keep, len(ids), i == keep and not kept, d))
            kept = kept or i == keep
    assert sorted(repr(tuple(r)) for r in exact_dedup.deduplicate(docs).collect()) == sorted(map(repr, expected))


def test_exact_of_no_rows(nothing):
    assert exact_dedup.deduplicate(nothing).collect() == []


def test_one_digest_for_two_texts_stops_the_job(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    pairs = spark.createDataFrame([("d", 1, 2)], "digest string, a long, b long")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: exact_dedup.F.lit("d"))
    with pytest.raises(ValueError):
        exact_dedup.check_bytes(docs, pairs)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, letters = int(rng.integers(0, 70)), int(rng.choice([1, 2, 3, 256]))
        text = bytes(rng.integers(0, letters, n, dtype=np.uint8))
        text = text[: n // 3 + 1] * 3 if rng.random() < 0.5 else text
        data = np.frombuffer(text, np.uint8)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(data).tolist() == order
        if len(text) > 1:
            lengths = [0] * len(text)
            for a, b in zip(order, order[1:]):
                while text[a + lengths[b] : a + lengths[b] + 1] == text[b + lengths[b] : b + lengths[b] + 1] != b"":
                    lengths[b] += 1
            assert permuted_prefixes(data, np.array(order)).tolist() == lengths


def test_suffix_array_of_long_repeats():
    rng = np.random.default_rng(6)
    for letters in (2, 3, 90, 256):
        passage = bytes(rng.integers(0, letters, 150, dtype=np.uint8))
        runs = bytes(range(letters)) + bytes([letters - 1]) * 40 + bytes(30) + bytes([letters // 2]) * 25
        parts = [passage[a : a + 70] for a in rng.integers(0, 100, 12)] + [passage, runs, runs[3:], passage]
        text = b"\xff".join(parts[i] for i in rng.permutation(len(parts)))
        order = suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lengths = permuted_prefixes(np.frombuffer(text, np.uint8), order)
        for a, b in zip(order.tolist(), order[1:].tolist()):
            n = int(lengths[b])
            assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] != text[b + n : b + n + 1]


def test_words_of_bytes_are_not_copied():
    data = np.frombuffer(bytes(range(250)) * 4000, np.uint8)
    tracemalloc.start()
    words = _words(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(data)
    padded = data.tobytes() + bytes(8)
    assert [int(words[i]) for i in (0, 3, len(data) - 2, len(data))] == [
        int.from_bytes(padded[i : i + 8], "little") for i in (0, 3, len(data) - 2, len(data))
    ]


def test_cells_of_joined_texts():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 49, 50, 300, 0, 51, 7, 120, 0)] + [b"a" * 90, b""]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    first, anchor, counts = suffix_dedup.anchors(data, lengths)
    hashes = suffix_dedup._hash24(_words(data), np.arange(len(data) - 23)) >> np.uint64(32)
    want, cells, begin = [], [], 0
    for text in texts:
        places = [w + int(np.argmin(hashes[w : w + 27])) for w in range(begin, begin + len(text) - 49)]
        new = [(w, p) for w, p, q in zip(range(begin, begin + len(text)), places, [None, *places]) if p != q]
        want, cells, begin = want + new, cells + [len(new)], begin + len(text)
    assert list(zip(first.tolist(), anchor.tolist())) == want and counts.tolist() == cells


def removed(docs):
    """Brute force over (doc_id, text)."""
    big = lambda x: float("inf") if x is None else x
    windows = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            windows[w] = min(windows.get(w, float("inf")), big(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if windows[b[k : k + 50]] < big(i):
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("common", [2, 1000])
@pytest.mark.parametrize("table", ["edge", "documents"])
def test_suffix_dedup_equals_brute_force(request, table, common, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    docs = request.getfixturevalue(table)
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.deduplicated(docs, texts=True)
    rows = got.collect()
    assert sorted(repr(tuple(r)[:5]) for r in rows) == removed(data)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_suffix_dedup_in_blocks_of_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 9, 60)]
    passages = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    data = [(i, " ".join(passages[p][rng.integers(0, 40) :] for p in rng.integers(0, 12, 3))) for i in range(40)]
    data += [(99, None), (None, passages[0]), (5, passages[1]), (100, "short")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for blocks, most in ((5, 16), (1, 64)):  # 64 shards in blocks of 12, the last one smaller, and in one block
        monkeypatch.setattr(suffix_dedup, "BLOCKS", blocks)
        monkeypatch.setattr(suffix_dedup, "SHARDS_A_BLOCK", most)
        rows = suffix_dedup.deduplicated(docs).collect()
        assert sorted(repr(tuple(r)) for r in rows) == removed(data)
    shard = rng.integers(0, 64, 500)
    for block, most in ((1, 64), (12, 6), (64, 1)):  # one message for each block, its shards one after the other
        parts = suffix_dedup._by_shard(shard, block)
        assert [n for n, _ in parts] == list(range(most))
        assert np.concatenate([p for _, p in parts]).tolist() == np.argsort(shard, kind="stable").tolist()


def test_suffix_dedup_of_no_rows(nothing):
    assert suffix_dedup.deduplicated(nothing).collect() == []
