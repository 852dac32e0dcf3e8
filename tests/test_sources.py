import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import checks, dense, prepare
from quarry.sources import writers


def scratch():
    return tempfile.mkdtemp(prefix="quarry-src-", dir="/tmp")


def qa_file(d, name="qa.jsonl"):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        for i in range(6):
            f.write(json.dumps({"query_id": str(i), "query": f"q {i}", "passages": {
                "passage_text": [" ".join(f"w{j}" for j in range(12 * (i + 1))), "short"],
                "is_selected": [1, 0]}}) + "\n")
        f.write("broken\n")
    return p


def test_splits_manifest_and_counts(spark, sf):
    d = scratch()
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("split"))
    man = writers.write_splits(df, d, "docs")
    back = writers.read_manifest(spark, d)
    assert sorted(r["split"] for r in back.collect()) == sorted(r["split"] for r in man.collect())
    rows = spark.read.json(os.path.join(d, "data"))
    res = checks.check_counts(rows, back).collect()
    assert all(r["count_match"] for r in res)


def test_prepare_dataset_and_stream_equal(spark):
    d = scratch()
    inp = os.path.join(d, "in")
    os.makedirs(inp)
    qa_file(inp)
    summary = writers.prepare_dataset(spark, inp, os.path.join(d, "out"), "train", max_tokens=10, stride=3).first()
    assert summary["num_queries"] == 6
    batch = spark.read.parquet(os.path.join(d, "out", "chunks"))
    q = writers.prepare_stream(spark, inp, os.path.join(d, "stream"), os.path.join(d, "ckpt"), 10, 3)
    q.awaitTermination(120)
    stream = spark.read.parquet(os.path.join(d, "stream"))
    a = {(r["chunk_id"], r["text"], r["tokens"]) for r in batch.collect()}
    b = {(r["chunk_id"], r["text"], r["tokens"]) for r in stream.collect()}
    assert a == b and len(a) > 12


def test_file_integrity(spark):
    d = scratch()
    p = qa_file(d)
    import hashlib
    want = hashlib.sha256(open(p, "rb").read()).hexdigest()
    r = checks.file_integrity(spark, p, {"file:" + p: want}).first()
    assert r["sha256"] == want and r["num_lines"] == 7 and r["size_bytes"] == os.path.getsize(p)
    assert r["hash_match"] is True


def test_embedding_table_dedupes(spark, sf):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    t = writers.build_embedding_table(docs, dense.HashingEncoder(16), max_docs=3)
    e = {r["id"]: r["embedding"] for r in t.collect()}
    assert e[1] == e[2] and e[1] != e[3] and len(e) == 3


def test_write_metrics_markdown(spark):
    m = spark.createDataFrame([("ndcg", 10, 0.5)], "metric string, k long, value double")
    md = writers.write_metrics(m, os.path.join(scratch(), "m"))
    assert "| ndcg | 10 | 0.5000 |" in md


def test_load_embedding_table(spark):
    from quarry.sources import readers
    d = scratch()
    spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.4])], "id long, embedding array<float>") \
         .write.parquet(os.path.join(d, "vec"))
    spark.createDataFrame([(1, "one")], "id long, text string").write.parquet(os.path.join(d, "txt"))
    vec, n = readers.load_embedding_table(spark, os.path.join(d, "vec"), os.path.join(d, "txt"))
    assert n == 2 and {r["id"]: r["text"] for r in vec.collect()} == {1: "one", 2: None}


def test_write_chunks_query_writes_every_language(spark, tmp_path):
    from quarry.plans.files import q_write_chunks
    rows = [(1, "some words here", "en", None, 15), (2, "altre parole qui", "it", None, 16), (3, "words of no language", None, None, 20), (4, "more words", "en", None, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.split for r in q_write_chunks(spark, str(tmp_path)).collect()), key=str)
    assert got == [None, "en", "en", "it"]
