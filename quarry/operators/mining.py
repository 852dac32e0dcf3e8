"""Hard-negative mining (N1-N11) as joins, windows and aggregations.

Deviations from the reference, on purpose:
* one id scheme: positives and candidates are both corpus doc ids, so
  positive exclusion actually matches (the reference mixes two schemes and
  never excludes anything);
* stage 3 combines ``teacher[:5]`` and the ANCE picks as a union keyed by
  doc id; the teacher score is kept where known and 0.0 otherwise (the
  reference's set union loses order and misaligns ids and scores).

Kept on purpose: stage 2 cuts to top-k *then* filters by confidence, so
fewer than k may survive; ANCE keeps ``score >= max_positive - margin``
with ``max_positive = 0.0`` when a query has no positive; texts missing from
the corpus are looked up as "".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions.text import PASSAGE_PREFIX, QUERY_PREFIX, packed_trigrams, set_jaccard
from quarry.operators import dense
from quarry.operators.lexical import LexicalIndex, bm25_search
from quarry.operators.relational import top_k_per_group
from quarry.session import cut_lineage


def _positives(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.col("rel") > 0).select("query_id", "doc_id").distinct()


def mine_bm25(index: LexicalIndex, queries: DataFrame, qrels: DataFrame, k: int = 100,
              exclude_positives: bool = True, pad_zero: bool = False) -> DataFrame:
    """BM25 top-k per query minus its positives (so fewer than k may
    remain) -> ``(query_id, doc_id, bm25_score, bm25_rank)``."""
    run = bm25_search(index, queries, k=k, pad_zero=pad_zero)
    if exclude_positives:
        run = run.join(_positives(qrels), ["query_id", "doc_id"], "left_anti")
    return run.select("query_id", "doc_id", F.col("score").alias("bm25_score"),
                      F.col("rank").alias("bm25_rank"))


def mine_teacher(cands: DataFrame, queries: DataFrame, corpus: DataFrame, scorer=None,
                 k: int = DEFAULTS.teacher_top_k, threshold: float = DEFAULTS.teacher_confidence,
                 band: tuple | None = None,
                 order_col: str = "bm25_rank") -> DataFrame:
    """N2 (+N9): score candidates with the teacher, keep the top-k, then
    those with confidence >= threshold (``band=(lo, hi)`` keeps the
    "confusing middle" instead). Ties keep candidate order."""
    scorer = scorer or dense.OverlapScorer()
    scored = dense.score_pairs(cands, queries, corpus, scorer)
    top = top_k_per_group(scored, ["query_id"],
                          [F.desc(F.round("teacher_score", 9)), F.asc(order_col), F.asc("doc_id")],
                          k, rank_col="teacher_rank")
    conf = scorer.confidence(F.col("teacher_score"))
    if band is not None:
        top = top.filter((conf >= band[0]) & (conf <= band[1]))
    else:
        top = top.filter(conf >= threshold)
    return top


def _student_scores(pairs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame,
                    metric: str) -> DataFrame:
    qv = query_vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("__qv"))
    dv = doc_vectors.select(F.col("id").alias("doc_id"), F.col("embedding").alias("__dv"))
    return (pairs.join(qv, "query_id", "left").join(dv, "doc_id", "left")
                 .withColumn("student_score",
                             F.coalesce(dense.pair_similarity("__qv", "__dv", metric), F.lit(0.0)))
                 .drop("__qv", "__dv"))


def encode_for_mining(encoder, queries: DataFrame, corpus: DataFrame, doc_ids: DataFrame,
                      prefixes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Encode the queries and only the documents that mining needs
    (candidates and positives), texts defaulting to ""; T8 prefixes."""
    q = queries.select(F.col("query_id").alias("id"),
                       (F.concat(F.lit(QUERY_PREFIX), F.col("query")) if prefixes else F.col("query")).alias("text"))
    needed = dense.attach_text(doc_ids.select("doc_id").distinct(), corpus)
    d = needed.select(F.col("doc_id").alias("id"),
                      (F.concat(F.lit(PASSAGE_PREFIX), F.col("text")) if prefixes else F.col("text")).alias("text"))
    return encoder.encode(q), encoder.encode(d)


def mine_ance(cands: DataFrame, qrels: DataFrame | None, query_vectors: DataFrame, doc_vectors: DataFrame,
              margin: float = DEFAULTS.ance_margin, k: int = DEFAULTS.ance_top_k, metric: str = "ip",
              order_col: str | None = "teacher_rank", version: int | None = None,
              max_pos: DataFrame | None = None) -> DataFrame:
    """N3 (+N10): candidates whose student score is within ``margin`` of the
    query's best positive, top-k by student score.

    Vectors are ``(id, embedding[, version])`` tables; ``version`` picks a
    snapshot, so re-mining against a newer student is the same call.
    ``max_pos`` may be given directly when relevance is defined by a group
    (then no (query, positive) pair table is needed).
    """
    if version is not None:
        query_vectors = query_vectors.filter(F.col("version") == version)
        doc_vectors = doc_vectors.filter(F.col("version") == version)
    if max_pos is None:
        pos = _student_scores(_positives(qrels), query_vectors, doc_vectors, metric)
        max_pos = pos.groupBy("query_id").agg(F.max("student_score").alias("max_pos"))
    else:  # precomputed (query_id, max_pos), e.g. a group-restricted top-1 search
        max_pos = max_pos.select("query_id", "max_pos")
    c = _student_scores(cands, query_vectors, doc_vectors, metric)
    c = c.join(max_pos, "query_id", "left").withColumn("max_pos", F.coalesce("max_pos", F.lit(0.0)))
    c = c.filter(F.col("student_score") >= F.col("max_pos") - margin)
    order = [F.desc(F.round("student_score", 9))]
    if order_col and order_col in c.columns:
        order.append(F.asc(order_col))
    order.append(F.asc("doc_id"))
    return top_k_per_group(c, ["query_id"], order, k, rank_col="ance_rank")


def mine_curriculum(stage: int, index: LexicalIndex, queries: DataFrame, qrels: DataFrame,
                    corpus: DataFrame, scorer=None, encoder=None, query_vectors=None,
                    doc_vectors=None, bm25_k: int = 100, threshold: float = 0.6,
                    margin: float = 0.1) -> DataFrame:
    """The three-stage curriculum -> ``(query_id, doc_id, teacher_score)``.

    1: BM25 negatives with score 0.0; 2: BM25 -> teacher (k = 10);
    3: BM25 -> teacher (k = 20) -> ANCE (k = 5), combined as
    ``teacher[:5]`` union ANCE keyed by doc id.
    """
    if stage not in (1, 2, 3):
        raise ValueError(f"the curriculum has stages 1 to 3, not {stage}")
    n1 = mine_bm25(index, queries, qrels, k=bm25_k)
    if stage == 1:
        return n1.select("query_id", "doc_id", F.lit(0.0).alias("teacher_score"))
    if stage == 2:
        t = mine_teacher(n1, queries, corpus, scorer, k=10, threshold=threshold)
        return t.select("query_id", "doc_id", "teacher_score")
    t = cut_lineage(mine_teacher(n1, queries, corpus, scorer, k=20, threshold=threshold))  # used three times
    if query_vectors is None or doc_vectors is None:
        if encoder is None:
            raise ValueError("stage 3 needs an encoder or precomputed vectors")
        ids = t.select("doc_id").unionByName(_positives(qrels).select("doc_id"))
        query_vectors, doc_vectors = encode_for_mining(encoder, queries, corpus, ids)
    a = mine_ance(t, qrels, query_vectors, doc_vectors, margin=margin, k=5)
    return combine_stages(t, a)


def combine_stages(teacher: DataFrame, ance: DataFrame, n_teacher: int = 5) -> DataFrame:
    """``teacher[:n]`` union ANCE picks, keyed by (query, doc); the
    teacher score where known, 0.0 otherwise."""
    t5 = teacher.filter(F.col("teacher_rank") <= n_teacher).select(
        "query_id", "doc_id", F.col("teacher_score").alias("ts"))
    a = ance.select("query_id", "doc_id", F.lit(None).cast("double").alias("ts"))
    u = t5.unionByName(a)
    return u.groupBy("query_id", "doc_id").agg(F.coalesce(F.max("ts"), F.lit(0.0)).alias("teacher_score"))


def denoise(cands: DataFrame, qrels: DataFrame, corpus: DataFrame, scorer=None,
            teacher_max: float = DEFAULTS.denoise_teacher_max,
            overlap_max: float = DEFAULTS.denoise_overlap_max) -> DataFrame:
    """Drop candidates the teacher rates as likely positive (confidence
    >= teacher_max) or whose text overlaps a positive's text by more than
    overlap_max (T2). Candidates per query are a capped list, so the
    candidate x positive join per query stays linear in the positives."""
    scorer = scorer or dense.OverlapScorer()
    # trigrams once for each document that is a candidate or a positive
    positives = _positives(qrels)
    needed = cands.select("doc_id").unionByName(positives.select("doc_id")).distinct()
    grams = (dense.attach_text(needed, corpus).select("doc_id", packed_trigrams("text").alias("__g")))
    pos_t = positives.join(grams, "doc_id").select("query_id", F.col("__g").alias("__p"))
    ov = (cands.select("query_id", "doc_id").join(grams, "doc_id").join(pos_t, "query_id")
           .groupBy("query_id", "doc_id").agg(F.max(set_jaccard(F.col("__g"), F.col("__p"))).alias("max_overlap")))
    out = cands.join(ov, ["query_id", "doc_id"], "left").fillna(0.0, ["max_overlap"])
    keep = F.col("max_overlap") <= overlap_max
    if "teacher_score" in cands.columns:
        keep = keep & (scorer.confidence(F.col("teacher_score")) < teacher_max)
    return out.filter(keep)


def cap_negatives(cands: DataFrame, n: int = DEFAULTS.negatives_per_query, score_col: str = "teacher_score") -> DataFrame:
    """At most n negatives per query, best teacher score first."""
    return top_k_per_group(cands, ["query_id"], [F.desc(F.round(score_col, 9)), F.asc("doc_id")], n,
                           rank_col="neg_rank")


def in_batch_negatives(queries: DataFrame, qrels: DataFrame, batch_size: int = 32,
                       n: int = 4, seed: int = 42) -> DataFrame:
    """Other queries' positives in the same (seeded) batch.

    Batches are bounded by ``batch_size``, so the within-batch pairing is
    bounded per group; own positives are removed (J2), then at most n per
    query in hash order."""
    from quarry.operators.relational import assign_batches
    b = assign_batches(queries.select("query_id"), "query_id", batch_size, seed)
    pos = _positives(qrels)
    owners = b.join(pos, "query_id").select("batch_id", F.col("query_id").alias("owner"), "doc_id")
    pairs = b.join(owners, "batch_id").filter(F.col("query_id") != F.col("owner"))
    pairs = pairs.join(pos, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id").distinct()
    pairs = pairs.withColumn("__h", F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.lit(str(seed)))))
    return top_k_per_group(pairs, ["query_id"], [F.asc("__h"), F.asc("doc_id")], n,
                           rank_col="neg_rank").drop("__h")


def mine_ance_corpus(query_vectors: DataFrame, doc_vectors: DataFrame, qrels: DataFrame | None,
                     top: int = 50, select: int = 10, metric: str = "ip",
                     exclude_self: bool = True, teacher: DataFrame | None = None,
                     teacher_max: float | None = None, group_col: str | None = None) -> DataFrame:
    """The student's nearest non-relevant neighbours over the whole
    corpus: exact ``top`` without each query's own positives, which are masked
    inside the search, so one query with many positives changes nothing for
    the others; then the ``select`` best, optionally only those the teacher
    rates low."""
    if group_col is not None:
        # relevance = same group: search the other groups directly
        q = query_vectors.select(F.col("id").alias("query_id"), "embedding", group_col)
        run = dense.flat_search(q, doc_vectors, k=top, metric=metric, exclude_self=exclude_self,
                                group_col=group_col, group_mode="other")
    else:
        q = query_vectors.select(F.col("id").alias("query_id"), "embedding")
        run = dense.flat_search(q, doc_vectors, k=top, metric=metric, exclude_self=exclude_self,
                                exclude=_positives(qrels))
    run = top_k_per_group(run.drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")],
                          top, rank_col="rank")
    if teacher is not None and teacher_max is not None:
        run = run.join(teacher.select("query_id", "doc_id", "teacher_score"), ["query_id", "doc_id"], "left") \
                 .filter(F.coalesce(F.col("teacher_score"), F.lit(0.0)) < teacher_max)
    return run.filter(F.col("rank") <= select) if teacher is None else \
        top_k_per_group(run.drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")],
                        select, rank_col="rank")


def mining_stats(negatives: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean negatives per query; queries without any count as 0."""
    per = negatives.groupBy("query_id").agg(F.count("*").alias("n"))
    allq = queries.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n"])
    return allq.agg(F.count("*").alias("queries"), F.sum("n").alias("negatives"),
                    F.avg("n").alias("avg_negatives"))
