"""Exact search in tiles: ties, masks, blocks, ids of other types; settings of approximate search from curves."""

import numpy as np
import pytest

from quarry.operators import ann, dense


def frame(spark, V, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(x) for x in v]) for i, v in enumerate(V)], f"id {'long' if ids is None else 'string'}, embedding array<float>")


def brute(Q, V, ids, k, left_out=()):
    S = Q.astype(np.float64) @ V.astype(np.float64).T
    return {q: sorted((j for j in range(len(V)) if (q, ids[j]) not in left_out), key=lambda j: (-round(S[q, j], 9), ids[j]))[:k] for q in range(len(Q))}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("tile", [dense.TILE_BYTES, 800])
def test_ties_and_masks(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(dense, "TILE_BYTES", tile)
    rng = np.random.default_rng(3)
    V = rng.integers(-1, 2, size=(260, 4)).astype(np.float32)  # most scores are shared by many
    V[100:200] = V[100]  # a large group of copies
    ids = [f"d{(i * 37) % 260:03d}" for i in range(260)]  # ids don't ascend
    df = frame(spark, V, ids).repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in V[i]]) for i in range(0, 40)], "query_id long, embedding array<float>")
    out = {(n, ids[(n * 7 + j) % 260]) for n in range(40) for j in range(n)}
    exclude = spark.createDataFrame([(*p, 1) for p in out for _ in range(2)] + [(999, "d001", 1), (3, "none", 1)], "query_id long, doc_id string, rel int")
    kw = dict(max_query_rows=0, block_rows=7) if blocks else {}
    for left_out, ex in ((set(), None), (out, exclude)):
        want = {n: [ids[j] for j in r] for n, r in brute(V[:40], V, ids, 12, left_out).items()}
        assert ranked(dense.flat_search(q, df, k=12, exclude=ex, **kw)) == want


def test_one_query_with_most_ids_left_out(spark):
    V = np.random.default_rng(4).normal(size=(120, 6)).astype(np.float32)
    df = frame(spark, V)
    q = df.withColumnRenamed("id", "query_id").where("query_id < 5")
    out = {(0, j) for j in range(115)}
    ex = spark.createDataFrame(sorted(out), "query_id long, doc_id long")
    got = ranked(dense.flat_search(q, df, k=10, exclude=ex))
    assert got == {n: r for n, r in brute(V[:5], V, range(120), 10, out).items()} and len(got[0]) == 5


def test_null_and_nan_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5, 0.0])], "id long, embedding array<float>")
    q = df.withColumnRenamed("id", "query_id")
    assert ranked(dense.flat_search(q, df, k=5)) == {0: [0, 2], 2: [0, 2]}
    bad = spark.createDataFrame([(3, [float("nan"), 1.0])], "id long, embedding array<float>")
    for a, b in ((q, df.union(bad)), (bad.withColumnRenamed("id", "query_id"), df)):
        with pytest.raises(Exception, match="NaN"):
            dense.flat_search(a, b, k=1).collect()
    assert dense.flat_search(q.limit(0), df, k=1).collect() == [] and dense.flat_search(q, df.limit(0), k=1).collect() == []
    assert dense.flat_search(q.limit(0), df, k=1, max_query_rows=-1).collect() == []


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 3
    return frame(spark, np.concatenate([c + rng.normal(size=(60, 8)) for c in centres]).astype(np.float32))


@pytest.mark.parametrize("spill", [False, True])
def test_probe_curve_is_what_the_search_gives(spark, clustered, spill):
    q = clustered.withColumnRenamed("id", "query_id").where("query_id % 5 = 0")
    exact = dense.flat_search(q, clustered, k=10, metric="l2", exclude_self=True)
    ivf = ann.build_ivf(clustered, nlist=12, seed=1, spill=spill)
    assert ivf["cells"].count() == (2 if spill else 1) * clustered.count()
    curve = ann.probe_curve(q, ivf, exact, metric="l2")
    assert len(curve) == 12 and curve[-1] == pytest.approx(1.0)
    for n in (1, 3, 12):
        run = ann.ivf_search(q, ivf, k=10, nprobe=n, metric="l2", exclude_self=True)
        assert run.groupBy("query_id", "doc_id").count().where("count > 1").count() == 0
        assert dense.validate_recall(run, exact, 10).first()["recall"] == pytest.approx(curve[n - 1], abs=0.002)
    n = ann.choose(curve, 0.9, 0.0)
    assert curve[n - 1] >= 0.9 and (n == 1 or curve[n - 2] < 0.9)
    if spill:
        plain = ann.probe_curve(q, ann.build_ivf(clustered, nlist=12, seed=1), exact, metric="l2")
        assert curve[0] > plain[0]


def test_depth_curve(spark, clustered):
    q = clustered.withColumnRenamed("id", "query_id").where("query_id % 5 = 0")
    exact = dense.flat_search(q, clustered, k=10, exclude_self=True)
    pq = ann.build_pq(clustered, m=4, nbits=3, seed=1)
    curve = ann.depth_curve(ann.pq_search(q, pq, k=300, exclude_self=True), exact)
    depth = ann.choose(curve, 0.9, 0.0)
    run = dense.rescore(ann.pq_search(q, pq, k=depth, exclude_self=True), clustered, clustered, 10)
    assert dense.validate_recall(run, exact, 10).first()["recall"] == pytest.approx(curve[depth - 1], abs=1e-9) and curve[depth - 1] >= 0.9


def test_ivfpq_blocks_of_queries(spark, clustered):
    q = clustered.withColumnRenamed("id", "query_id").where("query_id % 5 = 0")
    idx = ann.build_ivfpq(clustered, nlist=6, m=4, nbits=3, seed=1)
    assert ranked(ann.ivfpq_search(q, idx, k=8, nprobe=3, query_rows=10, shard_rows=40)) == ranked(ann.ivfpq_search(q, idx, k=8, nprobe=3))


@pytest.mark.parametrize("sf_dir", ["sf0.001", "sf0.01"])
def test_gates_hold_at_two_sizes(spark, sf, sf_dir):
    import __spark_entry__ as E

    path = sf.replace("sf0.001", sf_dir)
    for name in ("D4_ivf_gate", "D5_pq_gate"):
        assert E.queries()[name](spark, path).first()["passed"], name


def test_searches_hold_one_tile_of_scores(spark, monkeypatch):
    """No matrix of a whole group's queries and vectors: with small tiles the results stay, and no tile is larger."""
    rng = np.random.default_rng(21)
    V = rng.integers(-1, 2, size=(400, 8)).astype(np.float32)  # many equal scores
    V[100:250] = V[100]
    df, q = frame(spark, V), frame(spark, V).withColumnRenamed("id", "query_id")
    ivf, pq = ann.build_ivf(df, nlist=4, seed=1), ann.build_pq(df, m=4, nbits=3, seed=1)
    ivfpq = ann.build_ivfpq(df, nlist=4, m=4, nbits=3, seed=1)
    runs = {"ivf": lambda: ann.ivf_search(q, ivf, k=7, nprobe=4, exclude_self=True), "ivfpq": lambda: ann.ivfpq_search(q, ivfpq, k=7, nprobe=4, exclude_self=True),
            "pq": lambda: ann.pq_search(q, pq, k=7, exclude_self=True), "pq_blocks": lambda: ann.pq_search(q, pq, k=7, exclude_self=True, max_table_bytes=1)}
    whole = {n: ranked(f()) for n, f in runs.items()}
    assert whole["ivf"] == brute(V, V, range(400), 7, {(i, i) for i in range(400)}) and whole["pq"] == whole["pq_blocks"]
    add = dense._Best.add

    def bounded(self, rows, S, ids, n):
        assert S.nbytes <= 4000
        add(self, rows, S, ids, n)

    monkeypatch.setattr(dense, "TILE_BYTES", 4000)
    monkeypatch.setattr(dense._Best, "add", bounded)
    assert {n: ranked(f()) for n, f in runs.items()} == whole
    found = dense.best_of_tiles(np.arange(3), np.arange(900), 5, False, lambda rows: lambda cols: np.zeros((3, 900))[rows][:, cols])
    assert found[1].tolist() == [0, 1, 2, 3, 4] * 3


@pytest.mark.parametrize("k, c", [(1, 5), (3, 2), (5, 700), (40, 500)])
def test_best_of_each_row_by_sorting(k, c):
    rng = np.random.default_rng(k)
    best, seen = dense._Best(30, k), [[] for _ in range(30)]
    for n in range(6):
        S = np.round(rng.normal(size=(30, c)) * 3 ** (n % 3), 1 if n % 2 else 6)
        S[rng.random(S.shape) < (0.3 if n else 0.9)] = -np.inf
        if n == 4:
            S[:] = 0.5
        ids = np.sort(rng.choice(10_000, c, replace=False)) + 10_000 * n
        best.add(slice(0, 30), S, ids, 30)
        for r in range(30):
            seen[r] += [(-round(s, 9), i) for s, i in zip(S[r].tolist(), ids.tolist()) if s > -np.inf]
    q, ids, score = best.rows()
    for r in range(30):
        assert sorted(zip((-np.round(score[q == r], 9)).tolist(), ids[q == r].tolist())) == sorted(seen[r])[:k]


def test_jobs_and_groups_of_searches_in_blocks(spark, monkeypatch, clustered):
    """The exact search takes many small blocks in one job; the PQ search deals all queries into blocks, not a count that is cut
    at the bound of its tables, and into smaller ones where each query has many results."""
    q = clustered.withColumnRenamed("id", "query_id")
    jobs, search = [], dense._search_block
    monkeypatch.setattr(dense, "_search_block", lambda *a: jobs.append(1) or search(*a))
    assert ranked(dense.flat_search(q, clustered, k=4, exclude_self=True, max_query_rows=0, block_rows=10)) == ranked(dense.flat_search(q, clustered, k=4, exclude_self=True))
    assert len(jobs) == 2
    pq, n = ann.build_pq(clustered, m=4, nbits=3, seed=1), q.count()
    want = ranked(ann.pq_search(q, pq, k=6, exclude_self=True))
    sizes = []
    monkeypatch.setattr(ann.F, "sequence", lambda a, b, s=ann.F.sequence: sizes.append(str(b)) or s(a, b))
    assert ranked(ann.pq_search(q, pq, k=6, exclude_self=True, max_table_bytes=1, block_rows=100)) == want
    assert sizes[-1] == f"Column<'{-(-n // 100) - 1}'>"
    monkeypatch.setattr(ann, "RUN_ROWS", 300)
    assert ranked(ann.pq_search(q, pq, k=6, exclude_self=True, max_table_bytes=1, block_rows=100)) == want
    assert sizes[-1] == f"Column<'{-(-n // 50) - 1}'>"
