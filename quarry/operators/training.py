"""Training data and distillation losses.

Scores live in a long table ``(query_id, pos, student, teacher)``; ``pos``
is the document position inside the example (0 = the positive). Every loss
is computed per query and then averaged over queries, as the reference
trainer does (so with unequal list lengths it is *not* the mean over rows).

The per-query softmax quantities use two aggregations and one join - no
window sort: maxima first, then sums of ``exp(x - max)``. The KL term uses
``sum p_t (log p_t - log p_s) = A / S_t - lse_t + lse_s`` with
``A = sum exp(z_t - m_t) (z_t - z_s)``, which also makes ``0 log 0 = 0``.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import assign_batches  # noqa: F401  (K2 re-export)


def build_examples(positives: DataFrame, negatives: DataFrame, corpus: DataFrame,
                   queries: DataFrame | None = None) -> DataFrame:
    """K1: one row per (query, document) of a training example.

    Positives come first with teacher score 1.0, then the negatives with
    their mined teacher scores (best first); texts are attached ("" when
    missing). Output ``(query_id, pos, doc_id, text, teacher_score,
    is_positive)``; lists per query are bounded by the negative cap. The
    position is a ``row_number`` window: a sort per query that streams (no
    list is gathered), so even a query with very many positives only costs
    its sort.
    """
    p = positives.select("query_id", "doc_id", F.lit(1.0).alias("teacher_score"), F.lit(0).alias("__grp"))
    n = negatives.select("query_id", "doc_id", F.col("teacher_score").cast("double"), F.lit(1).alias("__grp"))
    u = p.unionByName(n)
    w = Window.partitionBy("query_id").orderBy("__grp", F.desc(F.round("teacher_score", 9)), "doc_id")
    ex = u.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    t = corpus.select("doc_id", "text")
    ex = ex.join(t, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    if queries is not None:
        ex = ex.join(queries.select("query_id", "query"), "query_id")
    return ex.withColumn("is_positive", (F.col("__grp") == 0).cast("int")).drop("__grp")


def temperature_at(start: float, end: float, progress, kind: str = "linear") -> Column:
    """K7: temperature schedule; ``progress`` in [0, 1] (column or number)."""
    p = progress if isinstance(progress, Column) else F.lit(float(progress))
    if kind == "linear":
        return F.lit(start) + (F.lit(end) - F.lit(start)) * p
    if kind == "cosine":
        return F.lit(end) + (F.lit(start) - F.lit(end)) * (1 + F.cos(F.lit(math.pi) * p)) / 2
    if kind == "constant":
        return F.lit(float(start))
    raise ValueError(f"unknown schedule {kind!r}")


def epoch_temperature(start: float, end: float, epoch: int, epochs: int, kind: str = "linear") -> float:
    """K7 as the trainer applies it: epoch e of E (1-based) uses progress e/E
    (so 3 epochs from 4 to 2 give 3.33, 2.67, 2.0)."""
    p = epoch / epochs
    if kind == "linear":
        return start + (end - start) * p
    if kind == "cosine":
        return end + (start - end) * (1 + math.cos(math.pi * p)) / 2
    return start


def per_query_losses(scores: DataFrame, temperature: float = 1.0,
                     contrastive_temperature: float = 0.05) -> DataFrame:
    """K3, K4, K5 per query -> ``(query_id, n, margin_mse, listwise_kd, contrastive)``."""
    if temperature <= 0 or contrastive_temperature <= 0:
        raise ValueError("temperatures must be positive")
    T, tau = float(temperature), float(contrastive_temperature)
    s, t = F.col("student").cast("double"), F.col("teacher").cast("double")
    m = scores.groupBy("query_id").agg(
        F.max(s).alias("smax"), F.max(t).alias("tmax"), F.count("*").alias("n"),
        F.min_by(s, F.col("pos")).alias("s0"))
    j = scores.join(m, "query_id")
    zs, zt = s / T, t / T
    ms, mt = F.col("smax") / T, F.col("tmax") / T
    agg = j.groupBy("query_id").agg(
        F.first("n").alias("n"), F.first("smax").alias("smax"), F.first("tmax").alias("tmax"),
        F.first("s0").alias("s0"),
        F.sum(((s - F.col("smax")) - (zt - mt)) ** 2).alias("sq"),
        F.sum(F.exp(zs - ms)).alias("S_s"),
        F.sum(F.exp(zt - mt)).alias("S_t"),
        F.sum(F.exp(zt - mt) * (zt - zs)).alias("A"),
        F.sum(F.exp(s / tau - F.col("smax") / tau)).alias("S_c"))
    lse_s = F.log("S_s") + F.col("smax") / T
    lse_t = F.log("S_t") + F.col("tmax") / T
    kl = F.col("A") / F.col("S_t") - lse_t + lse_s
    lse_c = F.log("S_c") + F.col("smax") / tau
    return agg.select("query_id", "n",
                      (F.col("sq") / F.col("n")).alias("margin_mse"),
                      (kl * (T * T)).alias("listwise_kd"),
                      (lse_c - F.col("s0") / tau).alias("contrastive"))


def kd_loss(scores: DataFrame, temperature: float = 1.0, weights=(0.6, 0.2, 0.2),
            contrastive_temperature: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """K6: weighted combination, averaged over queries. Weights must sum to
    1 (+/- 0.01). ``by`` keeps extra grouping keys (e.g. an epoch)."""
    if abs(sum(weights) - 1.0) > 0.01:
        raise ValueError(f"loss weights must sum to 1 (got {sum(weights)})")
    keys = list(by or [])
    if keys:
        scores = scores.withColumn("__qk", F.struct(*keys, "query_id"))
        pq = per_query_losses(scores.drop("query_id").withColumnRenamed("__qk", "query_id"),
                              temperature, contrastive_temperature)
        pq = pq.select(*[F.col(f"query_id.{k}").alias(k) for k in keys], "*")
    else:
        pq = per_query_losses(scores, temperature, contrastive_temperature)
    wm, wl, wc = weights
    out = pq.groupBy(*keys).agg(F.avg("margin_mse").alias("margin_mse"), F.avg("listwise_kd").alias("listwise_kd"),
                                F.avg("contrastive").alias("contrastive"), F.count("*").alias("queries"))
    return out.withColumn("loss", wm * F.col("margin_mse") + wl * F.col("listwise_kd") + wc * F.col("contrastive"))


def margin_mse(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """K3 averaged over queries."""
    return per_query_losses(scores, temperature).agg(F.avg("margin_mse").alias("margin_mse"))


def listwise_kl(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """K4 averaged over queries."""
    return per_query_losses(scores, temperature).agg(F.avg("listwise_kd").alias("listwise_kd"))


def contrastive(scores: DataFrame, temperature: float = 0.05) -> DataFrame:
    """K5 averaged over queries."""
    return per_query_losses(scores, 1.0, temperature).agg(F.avg("contrastive").alias("contrastive"))


def early_stop(metrics: DataFrame, patience: int = 2, mode: str = "min",
               run_col: str = "run", epoch_col: str = "epoch", value_col: str = "value") -> DataFrame:
    """K8: best epoch and stopping epoch per run.

    An epoch improves when it beats the running best of earlier epochs.
    Consecutive non-improving epochs are counted with a gaps-and-islands
    running sum; training stops at the first epoch where that count reaches
    ``patience``. Works for loss (mode "min") or nDCG (mode "max").
    """
    w_prev = Window.partitionBy(run_col).orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, -1)
    w_cur = Window.partitionBy(run_col).orderBy(epoch_col)
    best_prev = F.min(value_col).over(w_prev) if mode == "min" else F.max(value_col).over(w_prev)
    better = (F.col(value_col) < F.col("__bp")) if mode == "min" else (F.col(value_col) > F.col("__bp"))
    m = metrics.withColumn("__bp", best_prev).withColumn("improved", F.col("__bp").isNull() | better)
    m = m.withColumn("__grp", F.sum(F.col("improved").cast("int")).over(
        w_cur.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("stale", F.row_number().over(Window.partitionBy(run_col, "__grp").orderBy(epoch_col)) - 1)
    best = m.groupBy(run_col).agg(
        (F.min_by(epoch_col, F.col(value_col)) if mode == "min" else F.max_by(epoch_col, F.col(value_col))).alias("best_epoch"),
        (F.min(value_col) if mode == "min" else F.max(value_col)).alias("best_value"),
        F.min(F.when(F.col("stale") >= patience, F.col(epoch_col))).alias("stop_epoch"),
        F.max(epoch_col).alias("last_epoch"))
    return best.withColumn("stopped_early", F.col("stop_epoch").isNotNull())


def confident_queries(examples: DataFrame, threshold: float = 0.6, conf_col: str = "teacher_score",
                      fixed_col: str = "is_positive") -> DataFrame:
    """Keep queries whose maximum teacher confidence over the *mined*
    documents (positives have the fixed score 1.0 and are ignored) is at
    least ``threshold``; returns the examples of those queries."""
    best = (examples.filter(F.col(fixed_col) == 0).groupBy("query_id")
                    .agg(F.max(conf_col).alias("__best")).filter(F.col("__best") >= threshold))
    return examples.join(best.select("query_id"), "query_id", "left_semi")


# --------------------------------------------------------------- K9 (re-aimed)

def _loss_and_grad(ex: DataFrame, features: list[str], w: list[float], T: float, tau: float,
                   weights=(0.6, 0.2, 0.2)) -> tuple[float, list[float]]:
    """Combined loss of the linear student ``s = w.x`` and its gradient,
    averaged over queries, in two aggregations (maxima, then sums).

    Per query (n documents, d* = argmax s, position 0 = the positive):
      margin-MSE  (2/n) [sum r_d x_d - (sum r_d) x_{d*}],  r_d = (s_d - s_{d*}) - (t_d - t_max)/T
      listwise    T [sum p_s(d) x_d - sum p_t(d) x_d]      (softmax at T)
      contrastive (1/tau) [sum p_tau(d) x_d - x_0]

    Of documents with equal s the one at the first position is d*, so that a step gives the same gradient each time.
    """
    s = sum((F.lit(float(wi)) * F.col(f) for wi, f in zip(w, features)), F.lit(0.0))
    e = ex.withColumn("__s", s)
    m = e.groupBy("query_id").agg(
        F.max("__s").alias("smax"), F.max("teacher").alias("tmax"), F.count("*").alias("n"),
        F.max_by(F.struct(*[F.col(f).alias(f) for f in features]), F.struct("__s", -F.col("pos"))).alias("xstar"),
        F.min_by(F.struct(*[F.col(f).alias(f) for f in features]), F.col("pos")).alias("x0"),
        F.min_by("__s", F.col("pos")).alias("s0"))
    j = e.join(m, "query_id")
    es = F.exp(F.col("__s") / T - F.col("smax") / T)
    et = F.exp(F.col("teacher") / T - F.col("tmax") / T)
    ec = F.exp(F.col("__s") / tau - F.col("smax") / tau)
    r = (F.col("__s") - F.col("smax")) - (F.col("teacher") - F.col("tmax")) / T
    zs, zt = F.col("__s") / T, F.col("teacher") / T
    aggs = [F.first("n").alias("n"), F.first("smax").alias("smax"), F.first("tmax").alias("tmax"),
            F.first("s0").alias("s0"), F.first("xstar").alias("xstar"), F.first("x0").alias("x0"),
            F.sum(es).alias("Ss"), F.sum(et).alias("St"), F.sum(ec).alias("Sc"),
            F.sum(et * (zt - zs)).alias("A"), F.sum(r * r).alias("sq"), F.sum(r).alias("sr")]
    for i, f in enumerate(features):
        aggs += [F.sum(r * F.col(f)).alias(f"rx{i}"), F.sum(es * F.col(f)).alias(f"sx{i}"),
                 F.sum(et * F.col(f)).alias(f"tx{i}"), F.sum(ec * F.col(f)).alias(f"cx{i}")]
    pq = j.groupBy("query_id").agg(*aggs)
    lse_s = F.log("Ss") + F.col("smax") / T
    lse_t = F.log("St") + F.col("tmax") / T
    lse_c = F.log("Sc") + F.col("smax") / tau
    wm, wl, wc = weights
    loss = (wm * F.col("sq") / F.col("n") + wl * (T * T) * (F.col("A") / F.col("St") - lse_t + lse_s)
            + wc * (lse_c - F.col("s0") / tau))
    outs = [F.avg(loss).alias("loss")]
    for i, f in enumerate(features):
        g_mm = 2.0 / F.col("n") * (F.col(f"rx{i}") - F.col("sr") * F.col("xstar")[f])
        g_kl = T * (F.col(f"sx{i}") / F.col("Ss") - F.col(f"tx{i}") / F.col("St"))
        g_c = (F.col(f"cx{i}") / F.col("Sc") - F.col("x0")[f]) / tau
        outs.append(F.avg(wm * g_mm + wl * g_kl + wc * g_c).alias(f"g{i}"))
    row = pq.agg(*outs).first()  # one row of len(features) + 1 numbers
    return float(row["loss"]), [float(row[f"g{i}"]) for i in range(len(features))]


def loss_gradient(examples: DataFrame, features: list[str], w: list[float], temperature: float = 4.0, tau: float = 0.05,
                  weights=(0.6, 0.2, 0.2)) -> DataFrame:
    """One step's loss and gradient at ``w`` -> (feature, gradient, loss), a row for each feature."""
    ex = examples.select("query_id", "pos", F.col("teacher").cast("double"), *[F.col(f).cast("double") for f in features])
    loss, g = _loss_and_grad(ex, features, w, temperature, tau, weights)
    return examples.sparkSession.createDataFrame([(f, gi, loss) for f, gi in zip(features, g)], "feature string, gradient double, loss double")


def fit_linear_student(examples: DataFrame, features: list[str], epochs: int = 3, steps: int = 10,
                       lr: float = 0.05, t_start: float = 4.0, t_end: float = 2.0,
                       tau: float = 0.05, weights=(0.6, 0.2, 0.2), patience: int = 2,
                       w0: list[float] | None = None) -> tuple[list[float], list[dict]]:
    """K9: fit ``s = w.x`` over pair features against the teacher with the
    combined loss (K6), the epoch temperature schedule (K7) and early
    stopping on the epoch loss (K8).

    Full-batch gradient descent: every step is one Spark job whose result is
    the loss and a gradient of ``len(features)`` numbers; the driver holds
    only ``w``. The example table is persisted (spilling to disk) because
    every step reads it; nothing else grows across iterations.
    """
    if abs(sum(weights) - 1.0) > 0.01:
        raise ValueError("loss weights must sum to 1")
    ex = examples.select("query_id", "pos", F.col("teacher").cast("double"),
                         *[F.col(f).cast("double") for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    w = list(w0) if w0 is not None else [0.0] * len(features)
    history, best, stale = [], None, 0
    try:
        for epoch in range(1, epochs + 1):
            T = epoch_temperature(t_start, t_end, epoch, epochs)
            for _ in range(steps):
                loss, g = _loss_and_grad(ex, features, w, T, tau, weights)
                w = [wi - lr * gi for wi, gi in zip(w, g)]
            loss, _ = _loss_and_grad(ex, features, w, T, tau, weights)
            history.append({"epoch": epoch, "temperature": T, "loss": loss, "w": list(w)})
            if best is None or loss < best:
                best, stale = loss, 0
            else:
                stale += 1
                if stale >= patience:
                    break
    finally:
        ex.unpersist()
    return w, history


def alpha_at(progress, start: float = 0.8, end: float = 0.5, kind: str = "linear") -> Column:
    """K7 (config): weight of the distillation loss against the task loss,
    scheduled like the temperature (linear, cosine or constant)."""
    return temperature_at(start, end, progress, kind)


def blended_loss(kd: Column, task: Column, alpha: Column) -> Column:
    """``alpha * kd + (1 - alpha) * task``."""
    return alpha * kd + (F.lit(1.0) - alpha) * task
