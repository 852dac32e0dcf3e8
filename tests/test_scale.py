"""Behaviour that small tables don't show."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, metrics, relational
from quarry.plans.standins import containment_pairs
from quarry.sources import writers


def scratch():
    return tempfile.mkdtemp(prefix="quarry-scale-", dir="/tmp")


def test_global_row_number_of_two_million_rows_with_payload(spark):
    df = spark.range(2_000_000).select("id", F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), "id").alias("p"))
    g = relational.global_row_number(df, ["k", "id"], "rn")
    r = g.agg(F.count_distinct("rn").alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).first()
    assert (r["n"], r["lo"], r["hi"]) == (2_000_000, 1, 2_000_000)
    b = relational.assign_batches(df, "id", batch_size=32).groupBy("batch_id").count().groupBy("count").count().collect()
    assert [tuple(x) for x in b] == [(32, 62_500)]


def test_risk_coverage_of_many_rows_equals_numpy(spark):
    df = spark.range(500_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("score"),
                                     F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).alias("label"))
    got = [(r["point"], r["accuracy"]) for r in metrics.risk_coverage(df, id_col="id").orderBy("point").collect()]
    pdf = df.toPandas().sort_values(["score", "id"], ascending=[False, True])
    at = np.linspace(0, len(pdf) - 1, 100, dtype=int)
    acc = np.cumsum(pdf["label"].to_numpy())[at] / (at + 1)
    assert [p for p, _ in got] == list(range(100)) and np.allclose([a for _, a in got], acc)


def test_later_splits_leave_earlier_ones(spark):
    d = scratch()
    for s, n in (("train", 3), ("validation", 2), ("train", 4)):
        df = spark.range(n).select("id", F.lit(s).alias("split"))
        writers.write_chunks(df, os.path.join(d, "chunks"))
        writers.write_splits(df, os.path.join(d, "splits"), "ds")
    count = lambda p: {r["split"]: r["count"] for r in p.groupBy("split").count().collect()}
    assert count(spark.read.parquet(os.path.join(d, "chunks"))) == {"train": 4, "validation": 2}
    assert count(spark.read.json(os.path.join(d, "splits", "data"))) == {"train": 4, "validation": 2}
    assert {r["split"]: r["num_samples"] for r in writers.read_manifest(spark, os.path.join(d, "splits")).collect()} == {"train": 4, "validation": 2}


def test_large_reports_are_refused_not_cut(spark):
    m = spark.range(writers.MAX_REPORT_ROWS + 1).selectExpr("id AS k", "1.0D AS value")
    d = os.path.join(scratch(), "m")
    with pytest.raises(ValueError):
        writers.write_metrics(m, d)
    assert spark.read.json(d).count() == writers.MAX_REPORT_ROWS + 1


def test_many_short_items(spark):
    items = spark.range(12_000).selectExpr("id AS query_id", "concat('k', id, 'x') AS query")
    docs = spark.createDataFrame([(1, "see k17x and k11999x here"), (2, "k5 x"), (3, "ak5xb")], "doc_id long, text string")
    assert sorted(map(tuple, containment_pairs(items, docs).collect())) == [(5, 3), (17, 1), (11999, 1)]


def test_distinct_requests_have_one_representative(spark):
    req = spark.createDataFrame([("b", "x", 1), ("a", "x", 1), ("c", "y", 1)], "query_id string, query string, k int").repartition(3)
    seen = []

    def search(u):
        seen.extend(sorted(r["query_id"] for r in u.collect()))
        return u.select("query_id", F.col("query").alias("doc_id"))

    got = sorted(map(tuple, dense.search_distinct(req, search, F.col("query")).select("query_id", "doc_id").collect()))
    assert seen == ["a", "c"] and got == [("a", "x"), ("b", "x"), ("c", "y")]
