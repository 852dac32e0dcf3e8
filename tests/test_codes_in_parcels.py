"""Searches of PQ and IVF-PQ: codes go to the blocks of queries in parcels, and their scores are those of the lookup tables."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators import ann, dense


def frame(spark, X, text=False):
    return spark.createDataFrame([(f"d{i:04d}" if text else i, [float(a) for a in x]) for i, x in enumerate(X)], f"id {'string' if text else 'bigint'}, embedding array<float>")


def by_tables(Q, ids, K, books, k, base=None):
    """Sums of lookup tables: the k best of each query, itself left out."""
    out = {}
    for n, q in enumerate(Q):
        tables = [books[j] @ q[j * books.shape[2]:(j + 1) * books.shape[2]] for j in range(len(books))]
        score = sum(t[K[:, j]] for j, t in enumerate(tables)) + (0 if base is None else base[n])
        order = [i for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != ids[n] and np.isfinite(score[i])]
        out[ids[n]] = [(ids[i], round(float(score[i]), 8)) for i in order[:k]]
    return out


def ranked(run):
    out = {}
    for r in run.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 8)))
    return out


def held(codes, m):
    rows = sorted(codes.collect(), key=lambda r: r["id"])
    return np.array([r["id"] for r in rows]), ann._unpacked(pd.Series([bytes(r["codes"]) for r in rows]), m, 4) if isinstance(rows[0]["codes"], (bytes, bytearray)) else np.array([r["codes"] for r in rows])


@pytest.fixture(scope="module")
def X():
    rng = np.random.default_rng(12)
    X = np.concatenate([c + rng.normal(size=(50, 8)) for c in rng.normal(size=(6, 8)) * 3]).astype(np.float32)
    X[20:40] = X[20]  # equal scores
    return X


@pytest.mark.parametrize("text, pack", [(False, False), (True, True)])
def test_scores_are_those_of_the_tables(spark, X, text, pack):
    df = frame(spark, X, text)
    q = df.withColumnRenamed("id", "query_id")
    pq = ann.build_pq(df, m=4, nbits=4, seed=1, pack=pack)
    want = by_tables(X.astype(float), *held(pq["codes"], 4), pq["codebooks"], 9)
    for kw in ({}, {"max_table_bytes": 1, "block_rows": 70}, {"max_table_bytes": 1, "block_rows": 70, "shard_rows": 80}):
        assert ranked(ann.pq_search(q, pq, k=9, exclude_self=True, **kw)) == want, kw
    idx = ann.build_ivfpq(df, nlist=5, m=4, nbits=4, seed=1, pack=pack)
    rows = {r["id"]: r["cell"] for r in idx["codes"].select("id", "cell").collect()}
    ids, K = held(idx["codes"], 4)
    cells = np.array([rows[i] for i in ids])
    C = idx["centroids"]
    near = ann._probes(C, X.astype(float), 3, "ip")
    base = [np.where(np.isin(cells, near[n]), C[cells] @ x, -np.inf) for n, x in enumerate(X.astype(float))]
    want = by_tables(X.astype(float), ids, K, idx["codebooks"], 9, base)
    for kw in ({}, {"shard_rows": 25, "query_rows": 70}, {"shard_rows": 130}):
        assert ranked(ann.ivfpq_search(q, idx, k=9, nprobe=3, exclude_self=True, **kw)) == want, kw


def test_copies_for_blocks_are_few_rows(spark, monkeypatch, X):
    """What is dealt to 30 blocks: before, each code and, for each of its cells, each query."""
    df = frame(spark, X).coalesce(2)
    q = df.withColumnRenamed("id", "query_id")
    pq, idx = ann.build_pq(df, m=4, nbits=3, seed=1), ann.build_ivfpq(df, nlist=5, m=4, nbits=3, seed=1)
    dealt, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *a: dealt.append(self) or group(self, *a))
    for search in (lambda: ann.pq_search(q, pq, k=3, max_table_bytes=1, block_rows=10), lambda: ann.ivfpq_search(q, idx, k=3, nprobe=4, query_rows=10)):
        dealt.clear()
        assert search().count() == 3 * len(X)
        queries, codes = (x.count() for x in [x for x in dealt if {"query_id", "parcel", "codes"} & set(x.columns) and {"b", "block"} & set(x.columns)])
        assert queries == len(X) and codes <= 30 * 8


@pytest.mark.parametrize("nbits, cell", [(4, False), (9, True)])
def test_parcels_hold_each_code_once(spark, monkeypatch, nbits, cell):
    rng = np.random.default_rng(nbits)
    K = rng.integers(0, 2 ** nbits, size=(500, 3))
    rows = [(i, int(i % 7), int(i % 3), [int(c) for c in K[i]]) for i in range(500)]
    codes = spark.createDataFrame(rows, "id bigint, cell int, s int, codes array<smallint>")
    parcels = ann._parcels(codes if cell else codes.drop("cell"), ["s"], 3, None).toArrow()
    assert parcels.num_rows < 60
    for s in range(3):
        ids, own, cells = ann._opened(parcels.filter(dense.pc.equal(parcels["s"], s))["parcel"], 3)
        assert sorted(ids.tolist()) == list(range(s, 500, 3)) and (own == K[ids]).all()
        assert (cells == ids % 7).all() and (np.lexsort((ids, cells)) == np.arange(len(ids))).all() if cell else (np.diff(ids) > 0).all()


def test_few_codes_are_scored_exactly(monkeypatch):
    pairs, merge = [], dense._Best.merge_pairs
    monkeypatch.setattr(dense._Best, "merge_pairs", lambda self, first, at, ids, scores: pairs.append(len(at)) or merge(self, first, at, ids, scores))
    rng = np.random.default_rng(6)
    books, K, Q = rng.normal(size=(4, 16, 4)), rng.integers(0, 16, size=(30_000, 4)), rng.normal(size=(60, 16))
    monkeypatch.setattr(ann, "TILE_BYTES", 128 * 7000)
    best = dense._Best(60, 20)
    ann._add_codes(best, dense._Factors(Q, "ip", True), np.arange(60), True, K, np.arange(30_000), books)
    S = Q @ ann._decoded(K, books).T
    S[np.arange(60), np.arange(60)] = -np.inf
    assert [sorted(r) for r in best.ids.tolist()] == [sorted(np.lexsort((np.arange(30_000), -np.round(s, 9)))[:20].tolist()) for s in S]
    assert 60 * 20 <= sum(pairs) <= 0.02 * 60 * 30_000


def test_deep_searches_are_ranked_in_their_groups(spark, monkeypatch, X):
    """Where one group has all codes a query's results are not sorted again; a query may be asked with several vectors."""
    df = frame(spark, X)
    q = df.withColumnRenamed("id", "query_id")
    q = q.union(q.where("query_id < 9").withColumn("embedding", dense.F.reverse("embedding")))
    pq, idx = ann.build_pq(df, m=4, nbits=3, seed=1), ann.build_ivfpq(df, nlist=5, m=4, nbits=3, seed=1)
    for search, more in ((lambda **kw: ann.pq_search(q, pq, k=40, exclude_self=True, max_table_bytes=1, block_rows=90, **kw), {"shard_rows": 100}),
                         (lambda **kw: ann.ivfpq_search(q, idx, k=40, nprobe=3, exclude_self=True, query_rows=90, **kw), {"shard_rows": 100})):
        run = search()
        assert run.columns == ["query_id", "doc_id", "score", "rank"] and dict(run.dtypes)["rank"] == "bigint"
        assert "Window" not in run._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in run.collect()) == sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search(**more).collect())


def test_rescored_pairs_are_dealt_in_parcels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(200, 4)))
    run = spark.createDataFrame([(q, int(d)) for q in range(200) for d in rng.choice(200, 50, replace=False)], "query_id bigint, doc_id bigint").coalesce(1)
    want = ranked(dense.rescore(run, df, df, 5))
    dealt, spread = [], getattr(dense, "spread", None)
    monkeypatch.setattr(dense, "spread", lambda x, *a: dealt.append(x.count()) or spread(x, *a))
    monkeypatch.setattr(dense, "GRID_PAIRS", 2500)
    monkeypatch.setattr(dense, "RUN_ROWS", 1000)  # a group scores its pairs in slices
    assert ranked(dense.rescore(run, df, df, 5)) == want and sum(dealt) < 40


@pytest.mark.parametrize("k", [1, 5, 30])
def test_first_of_groups(k):
    rng = np.random.default_rng(k)
    group = np.sort(rng.integers(0, 40, 900)) * 3
    S, ids = np.round(rng.normal(size=900), 1), rng.permutation(900)
    S[rng.random(900) < 0.1] = np.nan
    S[group == 6] = np.nan
    want = [i for g in np.unique(group) for i in sorted(np.flatnonzero(group == g), key=lambda i: (np.isnan(S[i]), -S[i] if not np.isnan(S[i]) else 0, ids[i]))[:k]]
    assert dense._first(group, S, ids, k).tolist() == want
    assert dense._first(group[:0], S[:0], ids[:0], k).tolist() == []
