"""The token bucket by functions, against a request-by-request fold in fractions."""

import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.streaming import bucket
from quarry.streaming import requests as rq


def fold(rows, rpm, burst, idle):
    """rows: (client, microseconds), sorted; (passed, tokens left) of each."""
    out, state = [], {}
    for c, t in rows:
        y = Fraction(burst)
        if c in state:
            x, last = state[c]
            if idle is None or t - last <= idle * 1_000_000:
                y = min(y, x + Fraction(rpm).limit_denominator(1_000_000) * (t - last) / 60_000_000)
        state[c] = (y - 1 if y >= 1 else y, t)
        out.append((y >= 1, state[c][0]))
    return out


gaps = st.lists(st.sampled_from([0, 1, 100_000, 250_000, 500_000, 999_999, 1_000_000, 1_500_001, 4_000_000, 30_000_000]), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(gaps, st.sampled_from([1, 2, 3, 7.5]), st.sampled_from([60, 30, 7, 0.5]), st.integers(1, 9))
def test_a_function_gives_what_a_fold_gives(gaps, burst, rpm, part):
    r = bucket.rules(rpm, burst, None)
    add = bucket.refills(np.array(gaps, np.int64), r)

    def run(x, first):
        for j in range(first, len(add)):
            x = min(r.cap, x + int(add[j])) if j > first else x
            x -= r.unit if x >= r.unit else 0
        return x

    whole, = bucket.functions(add[None, :], np.ones((1, len(add)), bool), r)
    assert len(whole) <= 2 * burst + 8 + len(add)
    points = sorted({0, r.cap, *[p[0] for p in whole], *[max(p[0] - 1, 0) for p in whole], *[r.cap * k // 17 for k in range(17)]})
    assert [bucket.value(whole, x) for x in points] == [run(x, 0) for x in points]
    # composed of parts of any length
    starts = np.arange(0, len(add), part)
    _, there, a = bucket.table(starts, add)
    made, f = bucket.functions(a, there, r), None
    for s, g in zip(starts.tolist(), made):
        f = g if f is None else bucket.then(f, int(add[s]), g, r.cap)
    assert [bucket.value(f, x) for x in points] == [bucket.value(whole, x) for x in points]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0, 200_000, 700_000, 1_000_000, 5_000_000, 200_000_000])), min_size=1, max_size=80),
       st.sampled_from([None, 3, 100]), st.integers(1, 7), st.integers(1, 40))
def test_cut_anywhere(rows, idle, part, cut):
    t, log = 0, []
    for c, g in sorted(rows, key=lambda x: x[0]):
        t += g
        log.append((c, t))
    r = bucket.rules(60, 3, idle)
    old, bucket.PART = bucket.PART, part
    try:
        client, us = (np.array(x, np.int64) for x in zip(*log))
        before, x, got, f, head = None, r.cap, [], None, None
        for k in range(0, len(log), cut):
            passed, left = bucket.decide(client[k:k + cut], us[k:k + cut], before, x, r)
            got += [(bool(p), Fraction(int(v), r.unit)) for p, v in zip(passed, left)]
            f = bucket.through(client[k:k + cut], us[k:k + cut], before, f, r)
            before, x = (int(client[k:k + cut][-1]), int(us[k:k + cut][-1])), int(left[-1])
        assert got == fold(log, 60, 3, idle)
        assert bucket.value(f, r.cap) == x
    finally:
        bucket.PART = old


@pytest.mark.parametrize("rpm,burst", [(60, 5), (100, 20), (60 / 21600, 2), (7, 3)])
def test_a_client_with_most_events_spans_all_tasks(spark, rpm, burst):
    rng = random.Random(9)
    t, rows = 1_704_067_200_000_000, []
    for i in range(6000):
        t += int(rng.choice([0.0, 0.1, 0.5, 1, 2.5]) * 60e6 / rpm)  # it never pauses for a full bucket
        rows.append((i, t, 7 if i % 10 else i % 4))
    df = spark.createDataFrame([(i, dt.datetime.fromtimestamp(t // 10**6, dt.UTC) + dt.timedelta(microseconds=t % 10**6), c) for i, t, c in rows], "event_id long, ts timestamp, client long")
    got = {r["event_id"]: (r["client"], r["allowed"], r["tokens"], r["retry_after"]) for r in rq.token_bucket(df, rpm=rpm, burst=burst, idle_seconds=None).collect()}
    for c in (0, 1, 2, 3, 7):
        own = [(i, t) for i, t, k in rows if k == c]
        for (i, _), (passed, left) in zip(own, fold([(c, t) for _, t in own], rpm, burst, None)):
            assert got[i][:2] == (c, passed) and got[i][2] == pytest.approx(float(left), abs=1e-9)
            assert (got[i][3] is None) == passed and (passed or got[i][3] == pytest.approx(float((1 - left) * 60 / Fraction(rpm).limit_denominator(10**6))))
    assert len({r["pid"] for r in rq.token_bucket(df, rpm=rpm, burst=burst, idle_seconds=None).selectExpr("client", "spark_partition_id() AS pid").where("client = 7").distinct().collect()}) == 4


def test_nulls_and_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, None), (2, day, None), (3, day, None), (None, day, 0), (4, None, 0), (5, day, 0)], "event_id long, ts timestamp, client long")
    got = rq.token_bucket(df, rpm=60, burst=2, idle_seconds=None).collect()
    assert sorted((str(r["client"]), str(r["event_id"]), r["allowed"]) for r in got) == [
        ("0", "4", True), ("0", "5", True), ("0", "None", True), ("None", "1", True), ("None", "2", True), ("None", "3", False)]
    assert rq.token_bucket(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bucket.rules(0, 2, None)
