import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense


def vecs(spark, m, prefix="v"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>")


def brute(Q, V, k, exclude_self=False):
    out = {}
    S = Q @ V.T
    for q in range(len(Q)):
        order = sorted(range(len(V)), key=lambda j: (-round(S[q, j], 9), j))
        if exclude_self:
            order = [j for j in order if j != q]
        out[q] = order[:k]
    return out


@pytest.mark.parametrize("force_blocks", [False, True])
def test_flat_search_matches_brute_force(spark, force_blocks):
    rng = np.random.default_rng(0)
    V = rng.normal(size=(300, 16)).astype(np.float32)
    V[5] = V[7]  # exact tie
    df = vecs(spark, V)
    kw = dict(max_query_rows=0, block_rows=50) if force_blocks else {}
    res = dense.flat_search(df.withColumnRenamed("id", "query_id"), df, k=5, exclude_self=True, **kw).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute(V.astype(np.float64), V.astype(np.float64), 5, exclude_self=True)


def test_zero_vector_and_normalize(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, embedding array<float>")
    got = [r["n"] for r in df.select(dense.l2_normalize("embedding").alias("n")).orderBy("id").collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_dimension_mismatch(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception):
        dense.flat_search(q, v, k=1).collect()


def test_metrics_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    r = df.select(dense.pair_similarity("a", "b", "ip").alias("ip"), dense.pair_similarity("a", "b", "cosine").alias("c"),
                  dense.pair_similarity("a", "b", "l2").alias("l2")).collect()
    assert [x["ip"] for x in r] == [0.0, 4.0]
    assert [x["c"] for x in r] == pytest.approx([0.0, 1.0])
    assert [x["l2"] for x in r] == pytest.approx([-5.0, -2.0])


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, "hello WORLD"), (3, "")], "id long, text string")
    e = {r["id"]: r["embedding"] for r in dense.HashingEncoder(32).encode(df).collect()}
    assert e[1] == e[2] and np.linalg.norm(e[1]) == pytest.approx(1.0, abs=1e-6) and not any(e[3])


def test_fusion_rrf(spark):
    a = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 1.0, 1), ("q", "z", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    r = {x["doc_id"]: x["score"] for x in dense.fuse_rrf({"a": a, "b": b}, 60, 10).collect()}
    assert r["y"] == pytest.approx(1 / 62 + 1 / 61) and r["x"] == pytest.approx(1 / 61)


def test_ivf_full_probe_equals_exact_and_pq_paths_agree(spark):
    from quarry.operators import ann
    rng = np.random.default_rng(3)
    V = rng.normal(size=(200, 8)).astype(np.float32)
    df = vecs(spark, V)
    q = df.withColumnRenamed("id", "query_id")
    ivf = ann.build_ivf(df, nlist=4, seed=1)
    exact = {(r["query_id"], r["doc_id"]) for r in dense.flat_search(q, df, k=5, exclude_self=True).collect()}
    full = {(r["query_id"], r["doc_id"]) for r in
            ann.ivf_search(q, ivf, k=5, nprobe=4, exclude_self=True, shard_rows=20).collect()}
    assert full == exact
    pq = ann.build_pq(df, m=4, nbits=3, seed=1)
    a = {(r["query_id"], r["doc_id"]) for r in ann.pq_search(q, pq, k=5, exclude_self=True).collect()}
    b = {(r["query_id"], r["doc_id"]) for r in
         ann.pq_search(q, pq, k=5, exclude_self=True, max_table_bytes=1, block_rows=64).collect()}
    assert a == b


@pytest.mark.parametrize("force_blocks", [False, True])
def test_group_masked_search(spark, force_blocks):
    rng = np.random.default_rng(9)
    V = rng.normal(size=(120, 6)).astype(np.float32)
    lab = rng.integers(0, 4, size=120)
    df = spark.createDataFrame([(i, [float(x) for x in V[i]], int(lab[i])) for i in range(120)],
                               "id long, embedding array<float>, label int")
    kw = dict(max_query_rows=0, block_rows=40) if force_blocks else {}
    q = df.withColumnRenamed("id", "query_id")
    S = V.astype(np.float64) @ V.astype(np.float64).T
    for mode in ("same", "other"):
        res = dense.flat_search(q, df, k=3, exclude_self=True, group_col="label", group_mode=mode, **kw).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        for i in range(120):
            ok = [j for j in range(120) if j != i and ((lab[j] == lab[i]) == (mode == "same"))]
            want = sorted(ok, key=lambda j: (-round(S[i, j], 9), j))[:3]
            assert got.get(i, []) == want


def test_block_paths_with_many_shuffle_partitions(spark):
    """Regression: cogroup keys of different types (int vs bigint) hash to
    different partitions; with several partitions blocks never met."""
    from quarry.operators import ann
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    prevp = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rng = np.random.default_rng(11)
        V = rng.normal(size=(600, 8)).astype(np.float32)
        df = vecs(spark, V)
        q = df.withColumnRenamed("id", "query_id")
        exact = {(r["query_id"], r["doc_id"]) for r in dense.flat_search(q, df, k=5, exclude_self=True).collect()}
        blocks = {(r["query_id"], r["doc_id"]) for r in
                  dense.flat_search(q, df, k=5, exclude_self=True, max_query_rows=0, block_rows=100).collect()}
        assert blocks == exact
        ivf = ann.build_ivf(df, nlist=6, seed=2)
        full = {(r["query_id"], r["doc_id"]) for r in
                ann.ivf_search(q, ivf, k=5, nprobe=6, exclude_self=True, shard_rows=50).collect()}
        assert full == exact
        pq = ann.build_pq(df, m=4, nbits=3, seed=1)
        a = {(r["query_id"], r["doc_id"]) for r in ann.pq_search(q, pq, k=5, exclude_self=True).collect()}
        b = {(r["query_id"], r["doc_id"]) for r in
             ann.pq_search(q, pq, k=5, exclude_self=True, max_table_bytes=1, block_rows=100).collect()}
        assert a == b
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
        spark.conf.set("spark.sql.shuffle.partitions", prevp)


def test_ivfpq_recall_and_full_probe(spark):
    from quarry.operators import ann
    rng = np.random.default_rng(12)
    # clustered data: IVF-PQ should find most neighbours
    centers = rng.normal(size=(5, 8)) * 4
    V = np.concatenate([c + rng.normal(size=(60, 8)) for c in centers]).astype(np.float32)
    df = vecs(spark, V)
    q = df.withColumnRenamed("id", "query_id")
    idx = ann.build_ivfpq(df, nlist=5, m=4, nbits=4, seed=3)
    exact = dense.flat_search(q, df, k=10, exclude_self=True)
    cand = ann.ivfpq_search(q, idx, k=40, nprobe=5, exclude_self=True, shard_rows=30)
    approx = dense.rescore(cand, df, df, 10)
    rec = dense.validate_recall(approx, exact, 10).first()["recall"]
    assert rec > 0.9


def test_encode_with_prefix(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "id long, text string")
    enc = dense.HashingEncoder(16)
    a = {r["id"]: r["embedding"] for r in dense.encode(df, enc, kind="query").collect()}
    b = {r["id"]: r["embedding"] for r in enc.encode(spark.createDataFrame([(1, "query: hello")], "id long, text string")).collect()}
    assert a[1] == b[1] and len(a) == 2
