"""Preparation of whole catalogs, hashed encoders, hashes by ranges, improvement in one row."""

import hashlib
import json

import pytest

from quarry.operators import checks, dense, metrics
from quarry.sources import writers


def write(path, rows):
    path.write_text("".join((json.dumps(r) if not isinstance(r, str) else r) + "\n" for r in rows))
    return str(path)


def test_prepare_all_keeps_errors_and_replaces_splits(spark, tmp_path):
    qa = [{"query_id": str(k), "query": f"q {k}", "passages": {"passage_text": [f"word{k} " * 12, ""], "is_selected": [1, 0]}} for k in range(3)]
    texts = [{"doc_id": "a", "title": "Head", "text": "b c d"}, {"doc_id": "e", "title": "", "text": ""}, {"doc_id": "t", "title": "only", "text": None}, "{broken", {"doc_id": "n", "text": "x " * 25}]
    catalog = {"talks": {"kind": "qa", "splits": {"train": write(tmp_path / "qa.json", qa), "test": str(tmp_path / "none.json")}},
               "texts": {"kind": "corpus", "splits": {"corpus": write(tmp_path / "texts.json", texts)}}, "odd": {"kind": "picture", "splits": {"all": "x"}}}
    out = str(tmp_path / "out")
    run = lambda c: {(r["dataset"], r["split"]): r for r in writers.prepare_all(spark, c, out, max_tokens=10, stride=2).collect()}
    got = run(catalog)
    assert set(got) == {("talks", "train"), ("talks", "test"), ("texts", "corpus"), ("odd", "all")}
    assert (got["talks", "train"]["num_chunks"], got["talks", "train"]["num_queries"], got["talks", "train"]["num_docs"]) == (6, 3, 3)
    assert (got["texts", "corpus"]["num_chunks"], got["texts", "corpus"]["num_queries"], got["texts", "corpus"]["num_docs"]) == (5, None, 3)
    assert "PATH_NOT_FOUND" in got["talks", "test"]["error"] and "picture" in got["odd", "all"]["error"] and got["texts", "corpus"]["error"] is None
    chunks = {r["chunk_id"]: (r["title"], r["text"]) for r in spark.read.parquet(f"{out}/texts/chunks").collect()}
    assert chunks["a_0"] == ("Head", "Head\nb c d") and chunks["t_0"] == ("only", "only\n") and chunks["n_0"][0] == "" and "e_0" not in chunks
    # again: the same rows; then one split alone, whose row is replaced
    assert {k: v["num_chunks"] for k, v in run(catalog).items()} == {k: v["num_chunks"] for k, v in got.items()}
    write(tmp_path / "none.json", qa[:1])
    again = run({"talks": {"kind": "qa", "splits": {"test": str(tmp_path / "none.json")}}})
    assert len(again) == 4 and again["talks", "test"]["error"] is None and again["talks", "test"]["num_chunks"] == 2
    summary = {r["dataset"]: r for r in checks.integrity_summary(writers.prepared_reports(writers.read_prepared(spark, out))).collect()}
    assert summary["talks"]["passed"] and not summary["odd"]["passed"] and summary["odd"]["errors"] == "all:chunks;prepare"


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "c"), (2, None), (3, "b a A")], "id long, text string")
    got = [(r["id"], list(r["embedding"])) for r in dense.HashingEncoder(7).encode(df, normalize=False).collect()]
    want = []
    for i, t in [(1, "a b a"), (1, "c"), (2, ""), (3, "b a a")]:
        v = [0.0] * 7
        for w in t.split():
            h = int(hashlib.md5(f"0:{w}".encode()).hexdigest()[:15], 16)
            v[(h >> 1) % 7] += -1.0 if h % 2 else 1.0
        want.append((i, v))
    assert sorted(got) == sorted(want)
    assert dense.HashingEncoder(7, seed=1).encode(df, normalize=False).collect() != dense.HashingEncoder(7).encode(df, normalize=False).collect()


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 1234])
def test_tree_hash(spark, tmp_path, size):
    data = bytes(k % 251 for k in range(size))
    (tmp_path / "f").write_bytes(data)
    r = checks.tree_hash(spark, str(tmp_path / "f"), 100, 3).first()
    if not size:  # Spark lists no empty files
        assert r is None
        return
    leaves = [hashlib.sha256(data[k:k + 100]).hexdigest() for k in range(0, size, 100)]
    nodes = [hashlib.sha256("".join(leaves[k:k + 3]).encode()).hexdigest() for k in range(0, len(leaves), 3)]
    assert (r["size_bytes"], r["leaves"], r["tree_sha256"]) == (size, len(leaves), hashlib.sha256("".join(nodes).encode()).hexdigest())


def test_improvement_summary(spark):
    df = spark.createDataFrame([("ndcg", 1, 10.0), ("ndcg", 5, 30.0), ("ndcg", 20, 99.0), ("mrr", 20, 99.0), ("mrr", 1, -4.0)], "metric string, k int, improvement_pct double")
    r = metrics.improvement_summary(df).first()
    assert (r["avg_improvement_pct"], r["best_improvement_pct"], r["best_metric"]) == (20.0, 99.0, "mrr@20")
    assert metrics.improvement_summary(df.limit(0)).first()["best_metric"] is None
