"""The vector queries ask with every vector of the table, whatever its id."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexgrove.plans import bindings

N = 60
IDS = list(range(1, N + 1))  # one of them is divisible by 50
GOOD = {i for i in IDS if i % 3}
WITHOUT_TEXT = {7, 8}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("vectors")
    rows = np.random.default_rng(6).standard_normal((N, 8)).astype(np.float32)
    labels = [i % 3 for i in IDS]
    vectors = pa.array(rows.tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": IDS, "embedding": vectors, "label": pa.array(labels, pa.int32())}), at / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": IDS, "quality": [int(i in GOOD) for i in IDS], "toxic": [0] * N}), at / "labels.parquet")
    held = [i for i in IDS if i not in WITHOUT_TEXT]
    documents = {
        "doc_id": held, "text": [f"text {i}" for i in held], "lang": ["fr" if i % 4 == 0 else "en" for i in held],
        "source": [f"src{i % 5}" for i in held], "n_chars": [len(f"text {i}") for i in held],
    }
    pq.write_table(pa.table(documents), at / "documents.parquet")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    return str(at), np.round(unit @ unit.T, 9)


def nearest(scores, k, pool=frozenset(IDS)):
    """Best ``k`` ids of every query, in order."""
    return {q: sorted((i for i in IDS if i != q and i in pool), key=lambda i: (-scores[q - 1, i - 1], i))[:k] for q in IDS}


def ranks(best):
    return {(q, rank, i) for q, ids in best.items() for rank, i in enumerate(ids, 1)}


def test_knn_topk(spark, folder):
    at, scores = folder
    rows = bindings.knn_topk(spark, at).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in rows} == ranks(nearest(scores, 5)) and len(rows) == 5 * N


def test_knn_filtered(spark, folder):
    at, scores = folder
    rows = bindings.knn_filtered(spark, at).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in rows} == ranks(nearest(scores, 5, GOOD)) and len(rows) == 5 * N


def test_boosted_rerank(spark, folder):
    at, scores = folder
    weight = {0: 1.0, 1: 1.3, 2: 1.1}
    best = {
        q: sorted(ids, key=lambda i: -scores[q - 1, i - 1] * weight[i % 3])[:5] for q, ids in nearest(scores, 10).items()
    }
    rows = bindings.boosted_rerank(spark, at).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in rows} == ranks(best) and len(rows) == 5 * N


def test_hydrate_hits(spark, folder):
    at, scores = folder
    rows = bindings.hydrate_hits(spark, at).collect()
    want = {(q, rank, i, f"src{i % 5}") for q, rank, i in ranks(nearest(scores, 5)) if i not in WITHOUT_TEXT}
    assert {(r["query_id"], r["rank"], r["doc_id"], r["source"]) for r in rows} == want and len(rows) == len(want)


def test_hits_per_query(spark, folder):
    at, scores = folder
    rows = bindings.hits_per_query(spark, at).collect()
    want = {(q, len(GOOD.intersection(ids))) for q, ids in nearest(scores, 5).items()}
    assert {(r["query_id"], r["total_found"]) for r in rows} == want and len(rows) == N


def test_retrieval_metrics(spark, folder):
    at, scores = folder
    hits = {q: [i % 3 == q % 3 for i in ids] for q, ids in nearest(scores, 20).items()}
    same = N // 3 - 1
    for r in bindings.retrieval_metrics(spark, at).collect():
        found = [sum(h[: r["k"]]) for h in hits.values()]
        assert r["queries"] == N
        assert r["precision"] == pytest.approx(sum(found) / N / r["k"], abs=1e-6)
        assert r["recall"] == pytest.approx(sum(found) / N / same, abs=1e-6)
        assert r["mrr"] == pytest.approx(sum(1 / (h.index(True) + 1) if any(h) else 0 for h in hits.values()) / N, abs=1e-6)


def test_prompt_blocks(spark, folder):
    at, scores = folder
    rows = bindings.prompt_blocks(spark, at).collect()
    best = nearest(scores, 5)
    want = {(q, ", ".join(dict.fromkeys(f"src{i % 5}" for i in ids if i not in WITHOUT_TEXT))) for q, ids in best.items()}
    assert {(r["query_id"], r["case_list"]) for r in rows} == want and len(rows) == N
    assert all(r["prompt_chars"] > 100 for r in rows) and len({r["prompt_md5"] for r in rows}) == N


def test_verdict_blocks(spark, folder):
    at, scores = folder
    found = bindings.verdict_blocks(spark, at)
    rows = found.collect()
    cited = lambda ids: ", ".join(dict.fromkeys(f"src{i % 5}" for i in ids if i not in WITHOUT_TEXT and i % 4))
    want = {(q, cited(ids) or None) for q, ids in nearest(scores, 5).items()}
    assert {(r["query_id"], r["case_list"]) for r in rows} == want and len(rows) == N
    assert len({r["context_md5"] for r in rows}) == N
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # the search is not repeated
