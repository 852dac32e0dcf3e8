"""op13 against every period and every start, one after another."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.llm import op13_periodic_runs as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(w):
    """(start, length, period) of every run, by comparing words q apart for every q."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest())


def local(w):
    """The operator's steps without Spark: candidates, tiles, intervals, stitching."""
    import numpy as np

    x = np.array(w + [-2], np.int64)
    parts = []
    for P, centres in op13.candidates(x, len(w)):
        for c in centres.tolist():
            if c < len(w):
                lo, hi = max(0, c - 4 * P), min(len(w), c + 4 * P)
                parts += [(q, s + lo, e + lo) for q, s, e in op13.solve(w[lo:hi], c - lo, P)]
    return sorted(((s, e - s, q) for q, s, e in op13.merged(parts) if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 11)), min_size=1, max_size=6))
def test_tiles_find_every_run(blocks):
    w = [x for block, times, rest in blocks for x in block * times + block[:rest]]
    assert local(w) == brute_runs(w)


def texts():
    rng = random.Random(13)
    rows = [(None, None), (None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (5, "b a a a a a a b"),
            (6, "x y x y \x1cz " * 9), (7, "a b a b a b a b"), (8, "é " * 3000), (9, ("p q r s t u v " * 300) + "tail")]
    for k in range(10, 240):
        w = []
        while len(w) < rng.choice([3, 30, 300]):
            block = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 17, 40]))]
            w += block * rng.choice([1, 1, 2, 4, 6]) + block[:rng.randrange(4)]
        rows.append((k, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def test_equals_brute_force(spark, docs_of, rows):
    got = sorted(map(tuple, op13.periodic_runs(docs_of(rows)).select(*op13.COLUMNS).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert {r[1] for r in got} >= {0, 1, 2}


def test_same_in_any_blocks(spark, docs_of, rows, monkeypatch):
    whole = sorted(map(tuple, op13.periodic_runs(docs_of(rows)).collect()), key=repr)
    again = op13.periodic_runs(docs_of(rows[::-1]).repartition(7).withColumns({c: F.lit("x") for c in ("key", "plain", "octave", "period", "start", "end", "run", "runs", "words", "first")}))
    assert sorted(map(tuple, again.collect()), key=repr) == whole


def test_empty_table(spark):
    got = op13.periodic_runs(spark.createDataFrame([], DOCS))
    assert got.columns == list(op13.COLUMNS) and got.collect() == []


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = E.queries()["op13_runs"](spark, sf)
    assert sorted(map(tuple, got.select(*op13.COLUMNS).collect()), key=repr) == sorted((brute(*r) for r in docs), key=repr)
