"""How the driver's tables stand in for the reference's inputs.

* corpus      ``documents(doc_id, text)``; corpus order = ``doc_id``
* queries A   ``benchmark(item_id, text)`` -> ``(query_id, query)``
* qrels A     (item, document) pairs where the document contains the item's
              text verbatim -> ``(query_id, doc_id, rel=1)``
* queries B   user turns of ``conversations``; positive = the assistant turn
              right after it (corpus B = assistant turns)
* vectors     ``embeddings(vec_id, embedding, label)``; same label = relevant
              (applied as a rule, never as a pair table)
* labels      ``labels(doc_id, quality, toxic)``
* requests    ``events``: client = user_id, latency = value,
              error = event_type 'error'
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import split_ws
from quarry.operators.relational import bounded_rows, broadcast_if_small
from quarry.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _shingles(tokens, w: int):
    """All w-token shingles of a token array (empty when too short)."""
    return F.when(
        F.size(tokens) >= w,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (w - 1)),
                    lambda i: F.concat_ws(" ", F.slice(tokens, i, w))),
    ).otherwise(F.array().cast("array<string>"))


def _interior(w: int):
    """Shingles of an item's tokens without its first and last, which may be parts of a document's tokens."""
    return F.transform(F.sequence(F.lit(2), F.col("__n") - w), lambda i: F.concat_ws(" ", F.slice("__tok", i, w)))


def _char_grams(text, w: int):
    """Distinct runs of w characters (code points)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(\P{Cs}.{%d}))" % (w - 1)), F.lit(1)))


def containment_pairs(items: DataFrame, docs: DataFrame, item_id: str = "query_id",
                      item_text: str = "query", doc_id: str = "doc_id",
                      doc_text: str = "text", max_item_shingles: int = 2_000_000) -> DataFrame:
    """Pairs (item, doc) where ``doc_text`` contains ``item_text`` verbatim.

    No cross join: every item is keyed by its *rarest* part that a document
    must have, equi-joined with the documents' parts, and every candidate is
    verified with a substring test, so the result is exact. An item of n >= 3
    whitespace tokens makes its interior tokens (positions 1..n-2) whole tokens
    of a document that contains it; its parts are the interior shingles of
    min(3, n-2) tokens. A shorter item's parts are its runs of min(3, length)
    characters. Parts that no item has are left out before anything is shuffled.
    """
    it = items.select(F.col(item_id).alias("__iid"), F.col(item_text).alias("__itext"))
    it = it.filter(F.length("__itext") > 0).withColumn("__tok", split_ws("__itext"))
    it = it.withColumn("__n", F.size("__tok"))
    # kind: token shingles of width 1 to 3, or character grams of width 1 to 3 (negative)
    it = it.withColumn("__w", F.when(F.col("__n") >= 3, F.least(F.lit(3), F.col("__n") - 2)).otherwise(-F.least(F.lit(3), F.length("__itext"))))
    ws = sorted({r["__w"] for r in bounded_rows(it.select("__w").distinct(), 6, "kinds of parts")})
    if not ws:
        return items.sparkSession.createDataFrame([], f"{item_id} bigint, {doc_id} bigint")
    dk = docs.select(F.col(doc_id).alias("__did"), F.col(doc_text).alias("__dtext"))
    dtok = dk.withColumn("__tok", split_ws("__dtext"))
    own, there = None, None
    for w in ws:
        mine = it.filter(F.col("__w") == w)
        if w > 0:
            parts = _interior(w)
            doc_parts = F.array_distinct(_shingles(F.col("__tok"), w))
        else:
            parts, doc_parts = _char_grams(F.col("__itext"), -w), _char_grams(F.col("__dtext"), -w)
        a = mine.select("__iid", "__w", F.explode(parts).alias("__sh"))
        # distinct parts per document inside the row: no global distinct shuffle
        d = dtok.select("__did", F.lit(w).alias("__w"), F.explode(doc_parts).alias("__sh"))
        own = a if own is None else own.unionByName(a)
        there = d if there is None else there.unionByName(d)
    item_sh = broadcast_if_small(own.select("__w", "__sh").distinct(), max_item_shingles)
    # counted and joined: the documents are cut into parts once
    there = cut_lineage(there.join(item_sh, ["__w", "__sh"], "left_semi"))
    df = there.groupBy("__w", "__sh").agg(F.count("*").alias("__df"))
    ranked = own.join(df, ["__w", "__sh"], "left").fillna(0, ["__df"])
    best = ranked.groupBy("__iid", "__w").agg(
        F.min("__df").alias("__mindf"), F.min_by("__sh", F.struct("__df", "__sh")).alias("__sh"))
    best = best.filter(F.col("__mindf") > 0).select("__iid", "__w", "__sh")
    pairs = best.join(there, ["__w", "__sh"]).select("__iid", "__did").distinct()
    verified = (pairs.join(it.select("__iid", "__itext"), "__iid")
                     .join(dk, "__did")
                     .filter(F.col("__dtext").contains(F.col("__itext"))))
    return verified.select(F.col("__iid").alias(item_id), F.col("__did").alias(doc_id))


def qrels_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = containment_pairs(queries_a(spark, sf_dir), corpus(spark, sf_dir))
    return pairs.select("query_id", "doc_id", F.lit(1).alias("rel"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn -> the assistant turn right after it (equi-join on conv, turn+1)."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"),
        F.col("turn").alias("a_turn"))
    return u.join(a, ["conv_id", "turn"])


def queries_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_t"), F.col("turn")).alias("query_id"),
        F.col("text").alias("query"))


def corpus_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "assistant").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_t"), F.col("turn")).alias("doc_id"),
        F.col("text"))


def qrels_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pairs(spark, sf_dir)
    return p.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_t"), F.col("turn")).alias("query_id"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_t"), F.col("a_turn")).alias("doc_id"),
        F.lit(1).alias("rel"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by rule: two vectors are relevant to each other when they
    share a label. Operators take the label column (group masks, judged
    runs) instead of a (query, doc) pair table, which would hold every pair
    inside a label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client"),
        "event_type",
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )
