"""op12 against SQL, against exact fractions, and its skybands against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.llm import op12_source_divergence as op12

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """(text, lang, source) rows to the result's, with Python's unbounded integers."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, df, count = set(), defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        w, lang, source = words(t), lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(w))
        count[lang, source].update(w)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= 10]
        V = len(kept)

        def shares(c):
            N = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (N + 2 * V) for t in kept}

        mine = {s: shares(count[lang, s]) for x, s in groups if x == lang}
        q = shares(sum((count[lang, s] for s in mine), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in mine.items():
            pairs = sorted(((-sum(f(p[t], mine[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            terms = sorted((-f(p[t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[t] > q[t])[:10]
            out |= {(lang, s, part, i.decode(), -v, k + 1) for part, rows_ in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(rows_)}
    return out


def table(rng, n):
    """Many ties, few terms, sources of very unequal size."""
    rows = [(None, None, None), ("", "en", "only"), (None, "xx", "a"), ("one two", "xx", "b"), ("ÉCOLE école K \x00 a-b_c", None, "s")]
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None])
        k = min(int(rng.expovariate(0.7)), 6)
        rows.append((" ".join(rng.choice(["Alpha", "beta", "gamma", "é", "漢字", "x1y", "delta", "epsilon", f"s{chr(97 + k)}", f"w{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(30))), lang, f"src{k}"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return table(random.Random(12), 600)


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], DOCS)


def run(df):
    got = [tuple(r) for r in op12.divergences(df).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert run(frame(spark, rows)) == want
    more = frame(spark, rows[::-1]).repartition(5).withColumns({c: F.lit("x") for c in ("term", "n", "m", "d", "t", "b", "has", "value", "rank", "part", "item", "other", "both", "alone")})
    assert run(more) == want


def test_small_bounds_change_nothing(spark, rows, monkeypatch):
    """Counters, tiles and slices that are handed on early, in tasks here: the functions are called directly."""
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows], pa.string()) for k in (1, 2, 0)], names=["lang", "source", "t"])
    totals = lambda: sorted(pa.Table.from_batches(op12.count_terms([b])).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")]).to_pylist(), key=repr)
    whole = totals()
    monkeypatch.setattr(op12, "HELD", 20)
    monkeypatch.setattr(op12, "SLICE", 16)
    assert totals() == whole
    rng = random.Random(3)
    base = {f"s{k}": rng.randrange(1, 50) for k in range(40)}
    terms = [(s := rng.sample(sorted(base), rng.randrange(2, 9)), [rng.randrange(50, 10**9) for _ in s], [base[x] for x in s]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), *[pa.array([t[k] for t in terms]) for k in range(3)]], names=["lang", "source", "p", "b"])
    sums = lambda: {(r["source"], r["other"]): r["value_sum"] for r in pa.Table.from_batches(op12.shared([batch])).group_by(["source", "other"]).aggregate([("value", "sum")]).to_pylist()}
    want = Counter()
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for s, p, _ in terms:
        of = dict(zip(s, p))
        for x in s:
            for y in s:
                if x < y:
                    want[x, y] += f(of[x], of[y]) - f(of[x], base[y]) - f(base[x], of[y]) + f(base[x], base[y])
    assert sums() == dict(want)
    monkeypatch.setattr(op12, "TILE", 3)
    monkeypatch.setattr(op12, "TILES", 4)
    monkeypatch.setattr(op12, "CELLS", 90)
    assert sums() == dict(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 12)), max_size=700), st.integers(1, 300))
def test_skyband_is_exact_and_merges(pairs, cut):
    n, m = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    better = (n[None, :] >= n[:, None]) & (m[None, :] <= m[:, None]) & np.tril(np.ones((len(n), len(n)), bool), -1)
    want = better.sum(axis=1) < op12.TERMS
    assert (op12.Skyband().keep(n, m) == want).all()
    band, parts = op12.Skyband(), []
    for k in range(0, len(n), cut):
        parts.append(band.keep(n[k:k + cut], m[k:k + cut]))
    assert (np.concatenate([np.zeros(0, bool), *parts]) == want).all()
    odd = np.arange(len(n)) % 2 == 1  # two partitions, then merged
    left = np.sort(np.concatenate([np.flatnonzero(odd)[op12.Skyband().keep(n[odd], m[odd])], np.flatnonzero(~odd)[op12.Skyband().keep(n[~odd], m[~odd])]]))
    assert left[op12.Skyband().keep(n[left], m[left])].tolist() == np.flatnonzero(want).tolist()


def test_shares_are_exact(spark):
    rng = random.Random(5)
    rows = [(c, c + rng.randrange(10**k)) for k in range(1, 16) for c in (rng.randrange(1, 10**k), 2)] + [(7, 7)]
    got = spark.createDataFrame(rows, "c long, t long").selectExpr("c", "t", f"{op12.share('c', 't')} AS p").collect()
    assert all(r.p == 1 + 10**9 * r.c // r.t for r in got)


def test_empty_tables(spark):
    assert op12.divergences(spark.createDataFrame([], DOCS)).collect() == []
    assert run(frame(spark, [(None, None, None)] * 3)) == set()


def test_query_equals_its_sql(spark, sf, same):
    same(E.queries()["op12_divergence"](spark, sf), E.oracle_sql()["op12_divergence"])
