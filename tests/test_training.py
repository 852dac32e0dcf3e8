import math

import numpy as np
import pytest

from quarry.operators import training


def scores(spark, s, t):
    rows = []
    for q in range(s.shape[0]):
        for d in range(s.shape[1]):
            rows.append((f"q{q}", d, float(s[q, d]), float(t[q, d])))
    return spark.createDataFrame(rows, "query_id string, pos long, student double, teacher double")


def test_margin_mse_zero_when_teacher_is_scaled_student(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(4, 5))
    T = 2.0
    got = training.margin_mse(scores(spark, s, s * T), T).first()["margin_mse"]
    assert got == pytest.approx(0.0, abs=1e-12)


def test_listwise_zero_for_equal(spark):
    s = np.random.default_rng(2).normal(size=(4, 5))
    assert training.listwise_kl(scores(spark, s, s), 1.0).first()["listwise_kd"] == pytest.approx(0.0, abs=1e-12)


def test_contrastive_uniform_is_log_n(spark):
    s = np.zeros((4, 5))
    assert training.contrastive(scores(spark, s, s)).first()["contrastive"] == pytest.approx(math.log(5))


def kd_ref(s, t, T, tau=0.05, w=(0.6, 0.2, 0.2)):
    out = []
    for sq, tq in zip(s, t):
        ts = tq / T
        mm = np.mean(((sq - sq.max()) - (ts - ts.max())) ** 2)
        ls = sq / T - np.log(np.sum(np.exp(sq / T - (sq / T).max()))) - (sq / T).max()
        pt = np.exp(ts - ts.max()) / np.sum(np.exp(ts - ts.max()))
        kl = np.sum(np.where(pt > 0, pt * (np.log(np.where(pt > 0, pt, 1)) - ls), 0)) * T * T
        lc = sq / tau
        ct = -(lc[0] - (np.log(np.sum(np.exp(lc - lc.max()))) + lc.max()))
        out.append((mm, kl, ct))
    a = np.mean(out, axis=0)
    return a, w[0] * a[0] + w[1] * a[1] + w[2] * a[2]


def test_combined_loss_matches_numpy(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(6, 7)) * 3
    t = rng.normal(size=(6, 7)) * 1000  # large teacher logits: stability
    r = training.kd_loss(scores(spark, s, t), temperature=3.0).first()
    comps, total = kd_ref(s, t, 3.0)
    assert [r["margin_mse"], r["listwise_kd"], r["contrastive"]] == pytest.approx(list(comps), rel=1e-9)
    assert r["loss"] == pytest.approx(total, rel=1e-9)


def test_weights_must_sum_to_one(spark):
    s = np.zeros((1, 2))
    with pytest.raises(ValueError):
        training.kd_loss(scores(spark, s, s), weights=(0.5, 0.2, 0.2))


def test_temperature_schedule():
    assert [training.epoch_temperature(4.0, 2.0, p * 2, 2) for p in (0, 0.5, 1)] == [4.0, 3.0, 2.0]
    assert [round(training.epoch_temperature(4.0, 2.0, e, 3), 2) for e in (1, 2, 3)] == [3.33, 2.67, 2.0]


def test_early_stop(spark):
    m = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 0.8, 0.9, 0.85, 0.7, 0.95], 1)],
                              "run string, epoch int, value double")
    r = training.early_stop(m, patience=2).first()
    assert r["best_epoch"] == 5 and r["stop_epoch"] == 4 and r["stopped_early"]


def test_unequal_lists_mean_over_queries(spark):
    rows = [("a", 0, 1.0, 1.0), ("a", 1, 0.0, 5.0), ("b", 0, 0.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, pos long, student double, teacher double")
    pq = {r["query_id"]: r["margin_mse"] for r in training.per_query_losses(df, 1.0).collect()}
    got = training.margin_mse(df, 1.0).first()["margin_mse"]
    assert got == pytest.approx((pq["a"] + pq["b"]) / 2)


def test_linear_student_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(5):
        for d in range(4):
            x = rng.normal(size=2)
            rows.append((f"q{q}", d, float(x[0]), float(x[1]), float(rng.normal() * 2)))
    ex = spark.createDataFrame(rows, "query_id string, pos long, f0 double, f1 double, teacher double")
    w = [0.3, -0.2]
    loss, g = training._loss_and_grad(ex, ["f0", "f1"], w, 2.0, 0.5)
    eps = 1e-5
    for i in range(2):
        wp = list(w); wp[i] += eps
        wm = list(w); wm[i] -= eps
        lp, _ = training._loss_and_grad(ex, ["f0", "f1"], wp, 2.0, 0.5)
        lm, _ = training._loss_and_grad(ex, ["f0", "f1"], wm, 2.0, 0.5)
        assert g[i] == pytest.approx((lp - lm) / (2 * eps), rel=1e-4, abs=1e-6)
    # the loss equals the K6 loss of the induced student scores
    sc = ex.selectExpr("query_id", "pos", "0.3 * f0 - 0.2 * f1 AS student", "teacher")
    assert loss == pytest.approx(training.kd_loss(sc, 2.0, contrastive_temperature=0.5).first()["loss"])


def test_linear_student_loss_decreases(spark):
    rng = np.random.default_rng(6)
    rows = []
    for q in range(8):
        for d in range(5):
            x = rng.normal(size=2)
            rows.append((f"q{q}", d, float(x[0]), float(x[1]), float(3 * x[0] - x[1])))
    ex = spark.createDataFrame(rows, "query_id string, pos long, f0 double, f1 double, teacher double")
    w, hist = training.fit_linear_student(ex, ["f0", "f1"], epochs=2, steps=4, lr=0.02, tau=1.0)
    l0, _ = training._loss_and_grad(ex, ["f0", "f1"], [0.0, 0.0], hist[-1]["temperature"], 1.0)
    assert hist[-1]["loss"] < l0


def test_alpha_schedule_and_blend(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    got = [r["a"] for r in df.select(training.alpha_at(F.col("p")).alias("a")).collect()]
    assert got == pytest.approx([0.8, 0.65, 0.5])
    b = df.select(training.blended_loss(F.lit(2.0), F.lit(1.0), training.alpha_at(F.col("p"))).alias("b")).collect()
    assert [r["b"] for r in b] == pytest.approx([1.8, 1.65, 1.5])


def test_gradient_of_ties_takes_the_first_position(spark):
    """At weights of zero all documents tie: d* is position 0, whatever the order of the rows."""
    rows = [(q, p, float((q * 7 + p * 3) % 5), float((p * 5 + q) % 4), 1.0 / (p + 1)) for q in range(6) for p in range(5)]
    got = set()
    for parts, order in ((1, 1), (4, -1), (7, 1)):
        ex = spark.createDataFrame(rows[::order], "query_id int, pos int, teacher double, a double, b double").repartition(parts)
        got.add(tuple((r["feature"], round(r["gradient"], 9), round(r["loss"], 9)) for r in training.loss_gradient(ex, ["a", "b"], [0.0, 0.0], weights=(1.0, 0.0, 0.0)).collect()))
    want = np.zeros(2)
    for q in range(6):
        X, t = np.array([r[3:] for r in rows if r[0] == q]), np.array([r[2] for r in rows if r[0] == q])
        res = -(t - t.max()) / 4.0
        want += 2 / 5 * ((res[:, None] * X).sum(0) - res.sum() * X[0]) / 6
    assert len(got) == 1
    assert np.allclose([g[1] for g in got.pop()], want)
