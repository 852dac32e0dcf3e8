"""Approximate searches at a depth of many candidates: groups hand over k rows a query, and re-scoring copies no vector for a pair."""
import numpy as np
import pytest

from quarry.operators import ann, dense


def frame(spark, X, ids=None):
    return spark.createDataFrame([(int(i), None if x is None else [float(a) for a in x]) for i, x in zip(range(len(X)) if ids is None else ids, X)], "id bigint, embedding array<float>")


def ranked(run):
    return sorted((r["query_id"], r["rank"], r["doc_id"], None if r["score"] is None else round(r["score"], 6)) for r in run.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 8)) * 3
    return frame(spark, np.concatenate([c + rng.normal(size=(60, 8)) for c in centres]).astype(np.float32))


def handed_over(monkeypatch, search):
    """Rows that the groups of a search hand over, and what it finds."""
    seen, top = [], ann.top_k_per_group
    monkeypatch.setattr(ann, "top_k_per_group", lambda df, *a: seen.append(df) or top(df, *a))
    run = ranked(search())
    monkeypatch.undo()
    return seen[-1].count(), run


def test_groups_hand_over_k_rows_a_query(spark, vectors, monkeypatch):
    q, n = vectors.withColumnRenamed("id", "query_id"), vectors.count()
    pq, idx = ann.build_pq(vectors, m=4, nbits=3, seed=1), ann.build_ivfpq(vectors, nlist=6, m=4, nbits=3, seed=1)
    rows, run = handed_over(monkeypatch, lambda: ann.pq_search(q, pq, k=9, exclude_self=True, max_table_bytes=1, block_rows=64))
    assert rows == 9 * n and run == ranked(ann.pq_search(q, pq, k=9, exclude_self=True))
    assert run == ranked(ann.pq_search(q, pq, k=9, exclude_self=True, max_table_bytes=1, block_rows=100, shard_rows=70))
    rows, run = handed_over(monkeypatch, lambda: ann.ivfpq_search(q, idx, k=9, nprobe=5, exclude_self=True))
    assert rows == 9 * n
    for shard_rows in (30, 100, 200):  # cells split, alone and put together
        assert run == ranked(ann.ivfpq_search(q, idx, k=9, nprobe=5, exclude_self=True, shard_rows=shard_rows, query_rows=50)), shard_rows


def test_bundles_of_cells():
    assert ann._bundles({0: 5, 1: 4, 2: 30, 3: 1, 7: 9}, 10) == ({0: 0, 1: 0, 2: 1, 3: 2, 7: 2}, {0: 1, 1: 1, 2: 3, 3: 1, 7: 1})
    assert ann._bundles({}, 10) == ({}, {})


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_rescore_joins_no_vectors_to_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    X = [x for x in rng.integers(-2, 3, size=(90, 6))]  # equal scores
    X[7], X[11], X[20] = None, np.zeros(6), None
    df = frame(spark, X)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 95, size=(900, 2))})
    run = spark.createDataFrame(pairs + pairs[:40] + [(None, 3), (3, None)], "query_id bigint, doc_id bigint")
    e = run.distinct().join(df.selectExpr("id AS query_id", "embedding AS qv"), "query_id").join(df.selectExpr("id AS doc_id", "embedding AS dv"), "doc_id")
    e = e.select("query_id", "doc_id", dense.pair_similarity("qv", "dv", metric).alias("score"))
    want = ranked(dense.top_k_per_group(e, ["query_id"], [dense.F.desc(dense.F.round("score", 9)), dense.F.asc("doc_id")], 4))
    got = dense.rescore(run, df, df, 4, metric)
    assert ranked(got) == want and (metric == "cosine" or any(r[3] is None for r in want))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dense, "GRID_VECTORS", 25)
    monkeypatch.setattr(dense, "RUN_ROWS", 60)
    monkeypatch.setattr(dense, "TILE_BYTES", 500)
    assert ranked(dense.rescore(run, df, df, 4, metric)) == want
    assert dense.rescore(run.limit(0), df, df, 4, metric).collect() == [] and dense.rescore(run, df, df.limit(0), 4, metric).collect() == []


def test_rescore_of_text_ids_and_repeated_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [2.0, 2.0]), ("c", [3.0, 1.0])], "id string, embedding array<double>")
    run = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "x")], "query_id string, doc_id string")
    assert ranked(dense.rescore(run, df, df, 3)) == [("a", 1, "c", 3.0), ("a", 2, "b", 2.0), ("a", 3, "b", 0.0), ("b", 1, "c", 8.0), ("b", 2, "c", 1.0)]
