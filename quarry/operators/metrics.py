"""Ranking and calibration metrics (M1-M16) over long tables.

A *run* is ``(query_id, doc_id, score, rank)`` with 1-based ranks; *qrels*
is ``(query_id, doc_id, rel)``. Metrics come back as a long table
``(metric, k, value)`` so any number of cut-offs is computed in one pass.

Reference semantics kept on purpose:
* nDCG's ideal ordering is built from the labels of the truncated top-k
  list, not from all relevant documents (``ideal="full"`` gives the
  textbook form); gain is linear ``rel / log2(rank + 1)``.
* precision@k divides by k; recall@k is 0 for a query without relevant
  documents; both count a repeated document once.
* ECE bins are ``(lo, hi]``: confidence 0 is in no bin but counts in the
  denominator.
* Kendall's tau is taken over ids common to both rankings; fewer than two
  common ids gives 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import global_row_number


def _idcg(h: Column) -> Column:
    """sum_{j=1..h} 1/log2(j+1); 0 for h = 0 (``sequence(1,0)`` counts down)."""
    return F.when(h > 0, F.aggregate(F.sequence(F.lit(1), h.cast("int")), F.lit(0.0),
                                     lambda acc, j: acc + 1.0 / F.log2(j + 1))).otherwise(F.lit(0.0))


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Attach binary relevance to every retrieved row (missing -> 0)."""
    rel = (qrels.filter(F.col("rel") > 0).select("query_id", "doc_id").distinct()
                .withColumn("rel", F.lit(1)))
    return run.join(rel, ["query_id", "doc_id"], "left").fillna(0, ["rel"])


def per_query_metrics(run: DataFrame, qrels: DataFrame | None, ks: Sequence[int] = (10, 50, 100),
                      queries: DataFrame | None = None, ideal: str = "truncated",
                      n_rel: DataFrame | None = None) -> DataFrame:
    """Per-query nDCG/MRR/recall/precision at every k, one aggregation pass.

    Output: ``(query_id, ndcg_<k>, mrr_<k>, recall_<k>, precision_<k>, ...)``.
    With ``qrels=None`` the run must already carry a 0/1 ``rel`` column and
    ``n_rel(query_id, n_rel)`` gives the relevant count per query (relevance
    defined by a rule such as "same label", without a pair table).
    """
    j = judged_run(run, qrels) if qrels is not None else run
    # a document counts once, at its first rank; the window keeps the judging join's partitioning
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    j = j.withColumn("__first", first)
    aggs = [F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_rel")]
    for k in ks:
        in_k = F.col("rank") <= k
        aggs += [
            F.sum(F.when(in_k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(in_k, F.col("rel")).otherwise(0)).alias(f"hpos_{k}"),
            F.count_if(in_k & (F.col("rel") > 0) & F.col("__first")).alias(f"hits_{k}"),
        ]
    per_q = j.groupBy("query_id").agg(*aggs)
    if n_rel is None:
        n_rel = (qrels.filter(F.col("rel") > 0).groupBy("query_id")
                      .agg(F.count_distinct("doc_id").alias("n_rel")))
    qs = queries.select("query_id").distinct() if queries is not None else run.select("query_id").distinct()
    base = qs.join(per_q, "query_id", "left").join(n_rel, "query_id", "left").fillna(0, ["n_rel"])
    out = [F.col("query_id")]
    for k in ks:
        if ideal == "full":
            idcg = _idcg(F.least(F.col("n_rel"), F.lit(k)))
        else:
            idcg = _idcg(F.coalesce(F.col(f"hpos_{k}"), F.lit(0)))
        dcg = F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0))
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        out += [
            F.when(idcg > 0, dcg / idcg).otherwise(0.0).alias(f"ndcg_{k}"),
            F.when(F.col("first_rel") <= k, 1.0 / F.col("first_rel")).otherwise(0.0).alias(f"mrr_{k}"),
            F.when(F.col("n_rel") > 0, hits / F.col("n_rel")).otherwise(0.0).alias(f"recall_{k}"),
            (F.lit(0.0) if k == 0 else hits / F.lit(float(k))).alias(f"precision_{k}"),
        ]
    return base.select(*out)


def retrieval_metrics(run: DataFrame, qrels: DataFrame | None, ks: Sequence[int] = (10, 50, 100),
                      queries: DataFrame | None = None, ideal: str = "truncated",
                      metrics: Sequence[str] = ("ndcg", "mrr", "recall", "precision"),
                      n_rel: DataFrame | None = None) -> DataFrame:
    """M1-M4, M8: mean over queries -> long ``(metric, k, value)``."""
    pq = per_query_metrics(run, qrels, ks, queries, ideal, n_rel)
    aggs = [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in metrics for k in ks]
    wide = pq.agg(*aggs)
    pairs = ", ".join(f"'{m}', {k}, `{m}_{k}`" for m in metrics for k in ks)
    n = len(metrics) * len(ks)
    return wide.selectExpr(f"stack({n}, {pairs}) as (metric, k, value)").select(
        "metric", F.col("k").cast("bigint").alias("k"), F.col("value").cast("double").alias("value"))


def ndcg(run, qrels, ks=(10,), **kw) -> DataFrame:
    """M1."""
    return retrieval_metrics(run, qrels, ks, metrics=("ndcg",), **kw)


def mrr(run, qrels, ks=(10,), **kw) -> DataFrame:
    """M2."""
    return retrieval_metrics(run, qrels, ks, metrics=("mrr",), **kw)


def recall(run, qrels, ks=(100,), **kw) -> DataFrame:
    """M3."""
    return retrieval_metrics(run, qrels, ks, metrics=("recall",), **kw)


def precision(run, qrels, ks=(10,), **kw) -> DataFrame:
    """M4."""
    return retrieval_metrics(run, qrels, ks, metrics=("precision",), **kw)


def ece(df: DataFrame, confidence: str = "confidence", accuracy: str = "accuracy",
        n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """M5: expected calibration error with ``(lo, hi]`` bins.

    The bin is ``ceil(conf * n)`` corrected against the exact boundaries
    ``i/n`` so float rounding cannot move a value across an edge. One
    aggregation by bin, then one by group.
    """
    c = F.col(confidence).cast("double")
    raw = F.ceil(c * n_bins).cast("int")
    # exact boundary check: value must satisfy (b-1)/n < c <= b/n
    b = (F.when(c > raw / F.lit(float(n_bins)), raw + 1)
          .when(c <= (raw - 1) / F.lit(float(n_bins)), raw - 1).otherwise(raw))
    b = F.when((c > 0) & (c <= 1), b)
    keyed = df.withColumn("__bin", b)
    tot = keyed.groupBy(*by).agg(F.count("*").alias("__total"))
    bins = (keyed.filter(F.col("__bin").isNotNull()).groupBy(*by, "__bin")
                 .agg(F.count("*").alias("__n"), F.avg(c).alias("__conf"),
                      F.avg(F.col(accuracy).cast("double")).alias("__acc")))
    if by:
        joined = bins.join(tot, list(by))
    else:  # one global total: a scalar, applied as a literal
        total = tot.first()["__total"] if df.limit(1).count() else 0
        joined = bins.withColumn("__total", F.lit(total))
    contrib = joined.select(*by, (F.abs(F.col("__conf") - F.col("__acc")) * F.col("__n") / F.col("__total")).alias("c"))
    res = contrib.groupBy(*by).agg(F.sum("c").alias("ece"))
    if by:
        return tot.select(*by).join(res, list(by), "left").fillna(0.0, ["ece"])
    return res.select(F.coalesce(F.col("ece"), F.lit(0.0)).alias("ece"))


def kendall_tau(run_a: DataFrame, run_b: DataFrame, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """M6: tau per group over ids common to both rankings (tau-a = tau-b,
    ranks are distinct); fewer than two common ids -> 0.0.

    A repeated id keeps its last position (``max(rank)``). Discordant pairs are
    counted bit by bit: two second ranks differ first in one bit, so a pair is
    discordant if, in the order of the first ranking, the rank with that bit set
    comes before the one without, among ranks that agree in all higher bits.
    Every id makes one row per bit of its group's largest rank and one running
    sum per (group, bit, higher bits) counts them: n log n rows that spill, no
    pairs and no array of a group, however long its lists are.
    """
    key = list(key)
    a = run_a.groupBy(*key, "doc_id").agg(F.max("rank").alias("ra"))
    b = run_b.groupBy(*key, "doc_id").agg(F.max("rank").cast("bigint").alias("rb"))
    common = a.join(b, key + ["doc_id"])
    sizes = common.groupBy(*key).agg(F.count("*").alias("n"), F.length(F.bin(F.max("rb"))).alias("bits"))
    levels = (common.join(sizes, key).select(*key, "ra", "rb", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("level"))
              .withColumn("high", F.expr("shiftright(rb, level)")))
    one = F.col("high").bitwiseAND(F.lit(1))
    seen = (Window.partitionBy(*key, "level", "above").orderBy("ra", "rb")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (levels.select(*key, "level", "ra", "rb", one.alias("one"), F.expr("shiftright(high, 1)").alias("above"))
            .withColumn("before", F.sum("one").over(seen)))
    discordant = runs.groupBy(*key).agg(F.sum(F.when(F.col("one") == 0, F.col("before")).otherwise(0)).alias("d"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    tau = sizes.join(discordant, key).select(
        *key, F.when(F.col("n") >= 2, (pairs - 2 * F.col("d")) / pairs).otherwise(0.0).alias("tau"))
    allg = run_a.select(*key).unionByName(run_b.select(*key)).distinct()
    return allg.join(tau, key, "left").fillna(0.0, ["tau"])


def risk_coverage(df: DataFrame, score: str = "score", label: str = "label",
                  n_points: int = 100, id_col: str | None = None) -> DataFrame:
    """M7: accuracy of the i most confident rows for the sub-sampled i.

    Global rank without a single-partition window: range partitioning with
    per-partition offsets (``global_row_number``); the running label sum is
    obtained the same way from per-partition sums. Only the ranks picked by
    the truncated linspace are kept. Ties: score desc then ``id_col`` asc.
    """
    spark = df.sparkSession
    tie = id_col or score
    ordered = df.select(F.col(score).cast("double").alias("__s"), F.col(tie).alias("__t"),
                        F.col(label).cast("double").alias("__y"))
    ranked = global_row_number(ordered.withColumn("__neg", -F.col("__s")), ["__neg", "__t"], "__i")
    n = ranked.count()
    if n == 0:
        return spark.createDataFrame([], "point bigint, coverage double, accuracy double")
    # cumulative label sum: totals per block of ranks + running sum within a block;
    # the block follows from the rank, so it is the same in every evaluation
    nparts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rp = ranked.withColumn("__pid", F.floor((F.col("__i") - 1) / F.lit(float(-(-n // nparts)))).cast("int"))
    tot = rp.groupBy("__pid").agg(F.sum("__y").alias("__py"))
    wpid = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = F.broadcast(tot.withColumn("__off", F.coalesce(F.sum("__py").over(wpid), F.lit(0.0))).select("__pid", "__off"))
    win = Window.partitionBy("__pid").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    cum = rp.withColumn("__cy", F.sum("__y").over(win)).join(offs, "__pid")
    cum = cum.withColumn("__cum", F.col("__cy") + F.col("__off"))
    if n > n_points:
        # numpy.linspace(0, n-1, n_points, dtype=int): floor(j*(n-1)/(n_points-1))
        idx = spark.range(n_points).select(
            F.col("id").alias("point"),
            (F.floor(F.col("id") * F.lit(float(n - 1)) / F.lit(float(max(n_points - 1, 1)))) + 1).cast("bigint").alias("__i"))
        picked = cum.join(F.broadcast(idx), "__i")
    else:
        picked = cum.withColumn("point", F.col("__i") - 1)
    return picked.select(F.col("point").cast("bigint"),
                         (F.col("__i") / F.lit(float(n))).alias("coverage"),
                         (F.col("__cum") / F.col("__i")).alias("accuracy"))


def improvement(metrics: DataFrame, baseline: str, candidate: str,
                model_col: str = "model") -> DataFrame:
    """% improvement of candidate over baseline per metric (0 if baseline is 0)."""
    b = metrics.filter(F.col(model_col) == baseline).select("metric", "k", F.col("value").alias("base"))
    c = metrics.filter(F.col(model_col) == candidate).select("metric", "k", F.col("value").alias("cand"))
    j = b.join(c, ["metric", "k"])
    return j.select("metric", "k", "base", "cand",
                    F.when(F.col("base") != 0, (F.col("cand") - F.col("base")) / F.col("base") * 100.0)
                     .otherwise(0.0).alias("improvement_pct"))


def improvement_summary(improvements: DataFrame, metric: str = "ndcg", ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """The mean improvement of ``metric`` over ``ks`` and the best one of all metrics
    with its name (of equal ones the first by name and k) -> one row."""
    x = F.col("improvement_pct")
    best = F.max_by(F.struct(F.concat_ws("@", "metric", "k").alias("name"), x.alias("pct")), F.struct(x, F.lit(-1) * F.col("k"))).alias("best")
    first = improvements.groupBy("metric").agg(F.avg(F.when((F.col("metric") == metric) & F.col("k").isin(list(ks)), x)).alias("mean"), best)
    best = F.min_by("best", F.struct(-F.col("best.pct"), F.col("metric")))
    return first.agg(F.max("mean").alias("avg_improvement_pct"), best.alias("b")).select(
        "avg_improvement_pct", F.col("b.pct").alias("best_improvement_pct"), F.col("b.name").alias("best_metric"))


def acceptance_gate(metrics: DataFrame, student: str, teacher: str, metric: str = "ndcg",
                    k: int = 10, ratio: float = 0.95, model_col: str = "model") -> DataFrame:
    """Student value >= ratio * teacher value."""
    s = metrics.filter((F.col(model_col) == student) & (F.col("metric") == metric) & (F.col("k") == k)) \
               .select(F.col("value").alias("student"), F.lit(1).alias("__j"))
    t = metrics.filter((F.col(model_col) == teacher) & (F.col("metric") == metric) & (F.col("k") == k)) \
               .select(F.col("value").alias("teacher"), F.lit(1).alias("__j"))
    return s.join(t, "__j").select("student", "teacher",
                                   (F.col("student") >= ratio * F.col("teacher")).alias("passed"))


def compare_runs(runs: DataFrame, run_a: str, run_b: str, run_col: str = "run") -> DataFrame:
    """Difference and % change per shared numeric metric; % is NULL if the first is 0."""
    a = runs.filter(F.col(run_col) == run_a).select("metric", F.col("value").alias("v1"))
    b = runs.filter(F.col(run_col) == run_b).select("metric", F.col("value").alias("v2"))
    j = a.join(b, "metric")
    return j.select("metric", "v1", "v2", (F.col("v2") - F.col("v1")).alias("diff"),
                    F.when(F.col("v1") != 0, (F.col("v2") - F.col("v1")) / F.abs(F.col("v1")) * 100.0).alias("pct_change"))


def latest_runs(history: DataFrame, keys: Sequence[str] = ("model_name", "stage"),
                version: str = "version", ts: str = "registered_at") -> DataFrame:
    """Latest version per (model, stage) from an append-only history."""
    return history.groupBy(*keys).agg(F.max_by(F.col(version), F.col(ts)).alias("latest_version"),
                                      F.max(ts).alias("latest_at"))


def compare_models(runs: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 5, 10, 20),
                   model_col: str = "model", queries: DataFrame | None = None) -> DataFrame:
    """Retrieval metrics for many models in one job (model is a key).

    Runs carry a ``model`` column; the query id is made model-qualified so
    the one-pass per-query aggregation serves all models at once.
    """
    rel = qrels.filter(F.col("rel") > 0).select("query_id", "doc_id").distinct()
    j = runs.join(rel.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    aggs = [F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_rel")]
    for k in ks:
        in_k = F.col("rank") <= k
        aggs += [F.sum(F.when(in_k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
                 F.sum(F.when(in_k, F.col("rel")).otherwise(0)).alias(f"hpos_{k}")]
    per = j.groupBy(model_col, "query_id").agg(*aggs).join(n_rel, "query_id", "left").fillna(0, ["n_rel"])
    out = [F.col(model_col)]
    for k in ks:
        idcg = _idcg(F.col(f"hpos_{k}"))
        out += [F.when(idcg > 0, F.col(f"dcg_{k}") / idcg).otherwise(0.0).alias(f"ndcg_{k}"),
                F.when(F.col("first_rel") <= k, 1.0 / F.col("first_rel")).otherwise(0.0).alias(f"mrr_{k}")]
    pq = per.select(*out)
    aggs2 = [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("ndcg", "mrr") for k in ks]
    wide = pq.groupBy(model_col).agg(*aggs2)
    pairs = ", ".join(f"'{m}', {k}, `{m}_{k}`" for m in ("ndcg", "mrr") for k in ks)
    return wide.selectExpr(model_col, f"stack({2 * len(ks)}, {pairs}) as (metric, k, value)").select(
        model_col, "metric", F.col("k").cast("bigint"), F.col("value").cast("double"))


def ranking_agreement(scores: DataFrame, student: str = "student", teacher: str = "teacher",
                      n_bins: int = 10) -> DataFrame:
    """Mean Kendall tau between the student's and the teacher's ranking
    of each query's documents, and ECE of the globally min-max normalised
    student score where accuracy = (student_norm > 0.5) == (teacher_norm > 0.5)."""
    from quarry.operators.relational import minmax_scale, rank_within
    ra = scores.select("query_id", "doc_id", rank_within(["query_id"], [F.desc(F.round(student, 9)), F.asc("doc_id")]).alias("rank"))
    rb = scores.select("query_id", "doc_id", rank_within(["query_id"], [F.desc(F.round(teacher, 9)), F.asc("doc_id")]).alias("rank"))
    tau = kendall_tau(ra, rb).agg(F.avg("tau").alias("kendall_tau"))
    n = minmax_scale(minmax_scale(scores, student, "__sn"), teacher, "__tn")
    acc = n.select(F.col("__sn").alias("c"), ((F.col("__sn") > 0.5) == (F.col("__tn") > 0.5)).cast("double").alias("a"))
    e = ece(acc, "c", "a", n_bins)
    return tau.withColumn("__k", F.lit(1)).join(e.withColumn("__k", F.lit(1)), "__k").drop("__k")


def evaluate_lists(lists: DataFrame, ks: Sequence[int] = (1, 5, 10), score_col: str = "score") -> DataFrame:
    """Metrics over per-query candidate lists ``(query_id, doc_id,
    score, rel)``: rank by score (W1), then nDCG/MRR at each k."""
    from quarry.operators.relational import rank_within
    run = lists.withColumn("rank", rank_within(["query_id"], [F.desc(F.round(score_col, 9)), F.asc("doc_id")]))
    qrels = lists.select("query_id", "doc_id", "rel")
    return retrieval_metrics(run.select("query_id", "doc_id", F.col(score_col).alias("score"), "rank"),
                             qrels, ks, queries=lists.select("query_id").distinct(), metrics=("ndcg", "mrr"))


def evaluate_retrieval(query_vectors: DataFrame, doc_vectors: DataFrame, qrels: DataFrame | None,
                       ks: Sequence[int] = (1, 5, 10, 20), exclude_self: bool = False,
                       group_col: str | None = None, metrics: Sequence[str] = ("ndcg", "mrr")) -> DataFrame:
    """M9: exact retrieval over a shared corpus (D3, once at max k), labels
    joined by id (J7), nDCG/MRR at every k from the one ranked table.

    Relevance comes from ``qrels``, or - with ``group_col`` on both vector
    tables - from "same group" (judged row by row, no pair table).
    """
    from quarry.operators.dense import flat_search
    q = query_vectors.withColumnRenamed("id", "query_id")
    run = flat_search(q, doc_vectors, k=max(ks), exclude_self=exclude_self)
    queries = q.select("query_id")
    if group_col is None:
        return retrieval_metrics(run, qrels, ks, queries=queries, metrics=metrics)
    ql = query_vectors.select(F.col("id").alias("query_id"), F.col(group_col).alias("__qg"))
    dl = doc_vectors.select(F.col("id").alias("doc_id"), F.col(group_col).alias("__dg"))
    judged = run.join(ql, "query_id").join(dl, "doc_id").withColumn("rel", (F.col("__qg") == F.col("__dg")).cast("int"))
    sizes = doc_vectors.groupBy(F.col(group_col).alias("__qg")).agg(F.count("*").alias("__size"))
    n_rel = ql.join(sizes, "__qg", "left").select(
        "query_id", (F.coalesce("__size", F.lit(0)) - (1 if exclude_self else 0)).alias("n_rel"))
    return retrieval_metrics(judged, None, ks, queries=queries, metrics=metrics, n_rel=n_rel)
