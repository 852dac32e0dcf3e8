"""Block-max search against all scores: shards, blocks, parts of a batch, padding, other parameters, saved layout."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import lexical

N = 700


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"t{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    out = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) for _ in range(N)]
    out[50:60] = [out[50]] * 10  # ties
    return out


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(2)
    return [" ".join(f"t{min(119, int(rng.expovariate(0.04)))}" for _ in range(rng.randrange(1, 12))) for _ in range(25)] + ["", "none of these", "t0", "t0 t0 t119"]


def brute(texts, query, k, k1=1.5, b=0.75, pad=False):
    toks = [t.split() for t in texts]
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(toks) - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    avgdl = sum(map(len, toks)) / len(toks)
    rows = []
    for i, t in enumerate(toks):
        hit = [w for w in query.split() if w in t]
        s = sum(idf[w] * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avgdl)) for w in hit)
        if hit or pad:
            rows.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(rows)[:k]]


def run(index, spark, queries, k, **kw):
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    out = {n: [] for n in range(len(queries))}
    for r in lexical.bm25_search(index, qs, k=k, **kw).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["doc_id"], r["score"]))
    return out


def same(got, want):
    assert {q: [d for d, _ in r] for q, r in got.items()} == {q: [d for d, _ in r] for q, r in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in got for a, b in zip(got[q], want[q]))


@pytest.fixture(scope="module")
def index(spark, texts):
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old, few = lexical.BLOCK, lexical.FEW_DOCS
    lexical.BLOCK, lexical.FEW_DOCS = 16, 100  # many blocks a shard, several shards
    idx = lexical.build_lexical_index(corpus, "doc_id", "text")
    yield idx
    lexical.BLOCK, lexical.FEW_DOCS = old, few
    idx.close()


@pytest.mark.parametrize("k", [1, 7, 40, 1000])
def test_equals_all_scores(spark, index, texts, queries, k):
    want = {n: brute(texts, q, k) for n, q in enumerate(queries)}
    same(run(index, spark, queries, k), want)
    same(run(index, spark, queries, k, max_broadcast_rows=20), want)  # a batch in parts


@pytest.mark.parametrize("k", [5, 600, 900])
def test_padding_equals_all_scores(spark, index, texts, queries, k):
    want = {n: brute(texts, q, k, pad=True) for n, q in enumerate(queries)}
    same(run(index, spark, queries, k, pad_zero=True), want)
    same(run(index, spark, queries, k, pad_zero=True, max_broadcast_rows=20), want)


def test_other_parameters_on_the_same_tables(spark, index, texts, queries):
    same(run(index.reweighted(0.9, 0.4), spark, queries, 10), {n: brute(texts, q, 10, 0.9, 0.4) for n, q in enumerate(queries)})


def test_negative_weights(spark):
    """In a corpus where most terms are common the floor is below 0."""
    texts = ["a b"] * 7 + ["a", "b c", ""]
    idx = lexical.build_lexical_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    for pad in (False, True):
        same(run(idx, spark, ["a", "a b", "c a", "z"], 6, pad_zero=pad), {n: brute(texts, q, 6, pad=pad) for n, q in enumerate(["a", "a b", "c a", "z"])})


def test_blocks_that_cannot_reach_the_top_are_left_out(monkeypatch):
    """One shard of 4,000 documents; the rare term stands in one block of it."""
    monkeypatch.setattr(lexical, "BLOCK", 128)
    n = 4000
    dl = np.full(n, 50)
    own = {"k1": 1.5, "b": 0.75, "avgdl": 50.0}
    common, rare = np.arange(0, n, 2, dtype=np.int32), np.arange(1280, 1400, dtype=np.int32)
    rows = []
    for name, docs in (("common", common), ("rare", rare)):
        tf = np.ones(len(docs), np.int32)
        starts = np.flatnonzero(np.diff(docs // lexical.BLOCK, prepend=-1))
        rows.append({"term": name, "docs": docs.tolist(), "tfs": tf.tolist(), "tops": np.maximum.reduceat(lexical._factors(tf, dl[docs], own), starts).tolist()})
    kind = pa.schema([("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("tops", pa.list_(pa.float64()))])
    shard = lexical._Shard(pa.Table.from_pylist(rows, schema=kind), pa.table({"num": np.arange(n), "doc_id": np.arange(n), "pos": np.arange(n), "dl": dl}), own | {"stored": True})
    scored, factors = [], lexical._factors
    monkeypatch.setattr(lexical, "_factors", lambda tf, dl, own: scored.append(len(tf)) or factors(tf, dl, own))
    num, score = shard.search([0, 1], [0.1, 5.0], 20)
    assert num.tolist() == list(range(1280, 1320, 2)) and len(set(score.round(9))) == 1
    assert sum(scored) <= 4 * lexical.BLOCK < len(common)


def test_no_exchange_before_the_top(spark, index, queries):
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    plan = lexical.bm25_search(index, qs, k=5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroupsInArrow"):].split("Initial Plan")[0]
    assert "Exchange hashpartitioning" not in below and "Exchange rangepartitioning" not in below and below.count("Bucketed: true") == 2


def test_corpus_without_words(spark, tmp_path):
    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, "  "])], "doc_id long, text string")
    idx = lexical.build_lexical_index(corpus, "doc_id", "text")
    lexical.save_lexical_index(idx, str(tmp_path / "i"))
    for index in (idx, lexical.load_lexical_index(spark, str(tmp_path / "i")), lexical.build_lexical_index(corpus, "doc_id", "text", path=str(tmp_path / "j"))):
        assert run(index, spark, ["a", ""], 2) == {0: [], 1: []}
        assert run(index, spark, ["a", ""], 2, pad_zero=True) == {0: [(0, 0.0), (1, 0.0)], 1: [(0, 0.0), (1, 0.0)]}


def test_a_task_inverts_slices_of_a_shard(spark, monkeypatch, texts, queries, tmp_path):
    """Texts of a shard don't reach Python at once: the tokens of a group are bounded, whatever the shard holds."""
    seen, invert = str(tmp_path), lexical._invert

    def counted(docs, own):
        with open(f"{seen}/{docs['shard'][0].as_py()}-{docs['num'][0].as_py()}", "w") as f:
            f.write(str(docs.num_rows))
        return invert(docs, own)

    monkeypatch.setattr(lexical, "SLICE_TOKENS", 1)  # slices of one block
    monkeypatch.setattr(lexical, "_invert", counted)
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idx = lexical.build_lexical_index(corpus, "doc_id", "text")  # one or two shards
    held = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(held) == N and max(held) <= lexical.BLOCK
    rows = idx.postings.collect()
    assert len(rows) > len({(r["shard"], r["term"]) for r in rows})
    df = {r["term"]: r["df"] for r in idx.terms.collect()}
    assert df == {w: sum(w in t.split() for t in texts) for w in {w for t in texts for w in t.split()}}
    monkeypatch.setattr(lexical, "_invert", invert)
    for k in (7, 1000):
        same(run(idx, spark, queries, k), {n: brute(texts, q, k) for n, q in enumerate(queries)})
    same(run(idx.reweighted(0.9, 0.4), spark, queries, 10), {n: brute(texts, q, 10, 0.9, 0.4) for n, q in enumerate(queries)})
    idx.close()
