"""Readers (S1, S2, S3, S10, S11, S13, S14).

All readers declare their schema (no inference) and let Catalyst prune
columns and push filters into the Parquet scan.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.prepare import QA_SCHEMA, QA_SCHEMA_LIST

CORPUS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])


def read_qa_jsonl(spark: SparkSession, path: str, layout: str = "arrays") -> DataFrame:
    """QA JSON lines; malformed and blank lines are skipped, a missing
    ``query_id`` falls back to the query text, then to "".

    ``layout`` = "arrays" (struct of parallel arrays) or "list" (array of
    structs, the older format).
    """
    schema = QA_SCHEMA if layout == "arrays" else QA_SCHEMA_LIST
    df = (spark.read.schema(_with_corrupt(schema))
               .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
               .json(path))
    ok = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return ok.withColumn("query_id", F.coalesce(F.col("query_id"), F.col("query"), F.lit("")))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSON lines ``(doc_id, title, text)``; malformed lines skipped."""
    df = (spark.read.schema(_with_corrupt(CORPUS_SCHEMA))
               .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
               .json(path))
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_corpus(spark: SparkSession, path: str, id_col: str = "chunk_id",
                text_col: str = "text") -> DataFrame:
    """S3: Parquet corpus with chosen id and text columns -> ``(id, text)``.

    Only the two columns reach the scan (column pruning).
    """
    df = spark.read.parquet(path)
    missing = [c for c in (id_col, text_col) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found in {path}: {missing}")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def load_embedding_table(spark: SparkSession, path: str, text_path: str | None = None,
                         id_col: str = "id") -> tuple[DataFrame, int]:
    """Vectors (and optionally texts) plus the document count."""
    vec = spark.read.parquet(path)
    if text_path:
        vec = vec.join(spark.read.parquet(text_path), id_col, "left")
    return vec, vec.count()


def load_eval_set(chunks: DataFrame, max_queries: int | None = None,
                  order_col: str = "passage_idx") -> DataFrame:
    """Labelled test set grouped by query.

    The query text is the one of the first row, docs and labels are lists in
    passage order. Truncation (Q21) is by *queries* after grouping, using a
    dense rank of the query id - never by rows.

    Group size: a query's passages come from one QA record (one input row),
    so each list is no larger than the record it was exploded from.
    """
    g = chunks.groupBy("query_id").agg(
        F.min_by("query", F.col(order_col)).alias("query"),
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), "doc_id",
                                             F.col("is_relevant").alias("rel")))).alias("__l"))
    g = g.select("query_id", "query", F.col("__l.doc_id").alias("doc_ids"), F.col("__l.rel").alias("labels"))
    if max_queries is not None:
        g = g.orderBy("query_id").limit(max_queries)
    return g


def calibration_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows (hash order, seeded). The limit is
    the feature here: it is a sampling operator."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


@dataclass
class Catalog:
    """Dataset registry - names map to table paths and splits."""

    root: str
    datasets: dict = field(default_factory=dict)

    def register(self, name: str, splits: dict[str, str]):
        self.datasets[name] = dict(splits)

    def path(self, name: str, split: str) -> str:
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.datasets)}")
        if split not in self.datasets[name]:
            raise KeyError(f"unknown split {split!r} of {name!r}")
        return os.path.join(self.root, self.datasets[name][split])

    def read(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        return spark.read.parquet(self.path(name, split))

    def names(self) -> list[str]:
        return sorted(self.datasets)
