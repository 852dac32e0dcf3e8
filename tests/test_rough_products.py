"""Exact search by rough products: only pairs that may be among the best are scored in double precision, and results stay exact."""

import numpy as np
import pytest

from quarry.operators import dense


def found(Q, V, ids, k, metric, step=700, hide=lambda S, r, c: None):
    A, best = dense._Factors(Q, metric, True), dense._Best(len(Q), k)
    for at in range(0, len(V), step):
        order = np.argsort(ids[at:at + step], kind="stable")
        own, B = ids[at:at + step][order], dense._Factors(V[at:at + step][order], metric, False)
        best.hold(own, len(Q))
        dense._add_products(best, 0, A, slice(0, len(Q)), B, slice(0, len(own)), own, hide)
    q, own, score = best.rows()
    return [[x for _, x in sorted(zip((-np.round(score[q == n], 9)).tolist(), own[q == n].tolist()))] for n in range(len(Q))]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("case", ["normal", "ties", "close", "large", "text"])
def test_equals_all_scores(monkeypatch, metric, case):
    monkeypatch.setattr(dense, "ROUGH_COLS", 64)
    monkeypatch.setattr(dense, "ROUGH_ROWS", 16)
    rng = np.random.default_rng(5)
    V = rng.normal(size=(2000, 12))
    if case == "ties":
        V = rng.integers(-1, 2, size=V.shape).astype(float)
        V[300:900] = V[300]
    if case == "close":  # single precision can't tell them apart
        V = V[0] + 1e-7 * V
    if case == "large":
        V *= 1e20
    ids = rng.permutation(2000)
    ids = np.array([f"d{i:04d}" for i in ids]) if case == "text" else ids
    Q = V[:50]
    S = np.round(dense._scores(Q, V, metric), 9)
    for k in (1, 7, 40):
        got = found(Q, V, ids, k, metric)
        for n in range(len(Q)):
            order = np.lexsort((ids, -S[n]))
            if case in ("close", "large"):  # the last digits of a double depend on the order of a sum
                kth, off = S[n][order[k - 1]], 3e-9 + 1e-12 * np.abs(S[n]).max()
                at = {i: s for i, s in zip(ids.tolist(), S[n])}
                assert len(set(got[n])) == k and min(at[i] for i in got[n]) >= kth - off
            else:
                assert got[n] == ids[order[:k]].tolist()


def test_few_pairs_are_scored_exactly(monkeypatch):
    pairs, merge = [], dense._Best.merge_pairs
    monkeypatch.setattr(dense._Best, "merge_pairs", lambda self, first, at, ids, scores: pairs.append(len(at)) or merge(self, first, at, ids, scores))
    V = np.random.default_rng(6).normal(size=(20_000, 16))
    found(V[:100], V, np.arange(len(V)), 10, "ip", step=20_000)
    assert 100 * 10 <= sum(pairs) <= 0.01 * 100 * len(V)


def test_left_out_and_few_vectors():
    V = np.random.default_rng(7).normal(size=(30, 4))

    def hide(S, r, c):
        for n in range(len(S)):
            if 0 <= n + r - c < S.shape[1]:
                S[n, n + r - c] = -np.inf

    got = found(V, V, np.arange(30), 40, "ip", step=30, hide=hide)
    assert [sorted(x) for x in got] == [[j for j in range(30) if j != i] for i in range(30)]


def test_queries_of_a_group():
    group = np.array([0, 0, 1, 1, 1, 2])
    assert dense._asked(group, 1, "same") == [slice(2, 5)] and dense._asked(group, -1, "same") == []
    assert dense._asked(group, 1, "other") == [slice(0, 2), slice(5, 6)] and dense._asked(group, -1, "other") == [slice(0, 6)]
    assert dense._asked(group, 0, None) == [slice(0, 6)]


@pytest.mark.parametrize("mode", ["same", "other"])
@pytest.mark.parametrize("groups", [3, 200])
def test_groups(spark, mode, groups):
    rng = np.random.default_rng(8)
    V = rng.normal(size=(300, 5)).astype(np.float32)
    label = [None if i % 11 == 0 else int(x) for i, x in enumerate(rng.integers(0, groups, 300))]
    df = spark.createDataFrame([(i, [float(x) for x in v], label[i]) for i, v in enumerate(V)], "id long, embedding array<float>, label int").repartition(3)
    q = df.where("id < 60").withColumnRenamed("id", "query_id")
    S = np.round(V.astype(float) @ V.astype(float).T, 9)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(300) if j != i and (label[i] == label[j]) == (mode == "same")), key=lambda j: (-S[i, j], j))[:4]}
    got = dense.flat_search(q, df, k=4, exclude_self=True, group_col="label", group_mode=mode)
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == want


def test_vectors_are_made_once_for_all_jobs(spark, monkeypatch):
    """However many jobs a search in blocks takes; null vectors take no part in any."""
    monkeypatch.setattr(dense, "JOB_ROWS", 10)
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(len(b))
            yield b

    V = np.random.default_rng(9).normal(size=(120, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, None if i == 50 else [float(x) for x in v]) for i, v in enumerate(V)], "id long, embedding array<float>")
    q = df.withColumnRenamed("id", "query_id")
    got = dense.flat_search(q, df.mapInPandas(make, df.schema), k=3, max_query_rows=0, block_rows=10).collect()
    S = np.round(V.astype(float) @ V.astype(float).T, 9)
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(i, j) for i in range(120) if i != 50 for j in sorted((j for j in range(120) if j != 50), key=lambda j: (-S[i, j], j))[:3]}
    assert made.value <= 2 * 120
