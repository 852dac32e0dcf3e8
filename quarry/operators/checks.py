"""Data checks (C1-C10): fingerprints, counts, duplicates, required fields,
reports, request validation and label binarisation.

Each check is one distributed aggregation; reports are small tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_integrity(spark, paths: Sequence[str] | str, expected: dict | None = None) -> DataFrame:
    """SHA-256, size and line count per file, optional expected-hash match.

    Uses the ``binaryFile`` source (one row per file, so each file must stay
    under 2 GB; ``tree_hash`` has no such bound, ``fingerprint`` is the form for tables). Line counts come
    from the text source, counted in parallel and grouped by file name.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def norm(c):  # "file:/x", "file:///x" and "/x" name the same file
        return F.regexp_replace(c, "^file:/+", "/")
    files = (spark.read.format("binaryFile").load(paths)
                  .select(norm(F.col("path")).alias("path"), F.col("length").alias("size_bytes"),
                          F.sha2(F.col("content"), 256).alias("sha256")))
    lines = (spark.read.text(paths).select(norm(F.input_file_name()).alias("path"))
                  .groupBy("path").agg(F.count("*").alias("num_lines")))
    out = files.join(lines, "path", "left").fillna(0, ["num_lines"])
    if expected:
        exp = spark.createDataFrame(list(expected.items()), "path string, expected string") \
                   .withColumn("path", norm(F.col("path")))
        out = out.join(exp, "path", "left").withColumn(
            "hash_match", F.when(F.col("expected").isNull(), F.lit(None)).otherwise(F.col("expected") == F.col("sha256")))
    return out


def tree_hash(spark, paths: Sequence[str] | str, leaf_bytes: int = 8 << 20, fanout: int = 1024) -> DataFrame:
    """C1 for files of any size: a file is cut into ranges of ``leaf_bytes``, each hashed by a
    task of its own; ``fanout`` hashes in a row (lower-case hex) are hashed again, and so are
    those of the whole file -> ``(path, size_bytes, leaves, tree_sha256)``. Equal settings
    give equal hashes for equal contents. Spark lists no empty files, so those have no row."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    leaves = F.ceil(F.col("length") / leaf_bytes).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), leaves - 1)).alias("leaf"))
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "leaf")

    def read(batches):
        for b in batches:
            out = []
            for path, length, leaf in zip(*(c.to_pylist() for c in b.columns)):
                fs, p = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                h, left = hashlib.sha256(), min(leaf_bytes, length - leaf * leaf_bytes)
                with fs.open_input_file(p) as f:
                    f.seek(leaf * leaf_bytes)
                    while left > 0:
                        data = f.read(min(left, 1 << 20))
                        if not data:
                            raise ValueError(f"{path} ends before its {length} bytes")
                        h.update(data)
                        left -= len(data)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["path", "length", "leaf", "hash"])

    hashes = ranges.mapInArrow(read, "path string, length long, leaf long, hash string")

    def joined(c):  # hashes in the order of their places
        return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(c, "hash"))), lambda x: x["hash"])), 256)

    nodes = hashes.groupBy("path", "length", F.floor(F.col("leaf") / fanout).alias("node")).agg(joined("leaf").alias("hash"), F.count("*").alias("n"))
    return nodes.groupBy("path", F.col("length").alias("size_bytes")).agg(F.sum("n").alias("leaves"), joined("node").alias("tree_sha256")).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "size_bytes", "leaves", "tree_sha256")


def check_counts(df: DataFrame, manifest: DataFrame, split_col: str = "split") -> DataFrame:
    """Actual rows per split against the manifest's ``num_samples``."""
    actual = df.groupBy(split_col).agg(F.count("*").alias("actual"))
    m = manifest.select(F.col(split_col), F.col("num_samples").cast("bigint").alias("expected"))
    j = m.join(actual, split_col, "full").fillna(0, ["actual", "expected"])
    return j.withColumn("count_match", F.col("actual") == F.col("expected"))


def check_duplicates(df: DataFrame, id_col: str, order_col: str, n_examples: int = 10) -> DataFrame:
    """Distinct ids, number of repeat occurrences (n-1 per id), flag and
    the first ``n_examples`` repeat occurrences in ``order_col`` order.

    NULL and empty-string ids are skipped (as the reference skips falsy ids);
    a numeric 0 is counted (deliberate fix).
    """
    valid = df.filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    per = valid.groupBy(id_col).agg(F.count("*").alias("c"), F.min(order_col).alias("first_pos"))
    summary = per.agg(F.count("*").alias("total_ids"),
                      F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("num_duplicates"))
    # repeat occurrences = rows after the first per id; keep the earliest n
    rep = (valid.select(id_col, order_col)
                .join(per.filter(F.col("c") > 1).select(id_col, "first_pos"), id_col)
                .filter(F.col(order_col) > F.col("first_pos"))
                .orderBy(order_col, id_col).limit(n_examples))
    examples = rep.agg(F.concat_ws(",", F.collect_list(F.col(id_col).cast("string"))).alias("duplicate_ids"))
    # both sides are single-row aggregates
    return (summary.withColumn("__k", F.lit(1))
                   .join(examples.withColumn("__k", F.lit(1)), "__k").drop("__k")
                   .withColumn("has_duplicates", F.col("num_duplicates") > 0)
                   .select("total_ids", "num_duplicates", "has_duplicates", "duplicate_ids"))


def check_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """C4: per required field the number of rows where it is missing/NULL;
    ``schema_valid`` when all are zero. Fields absent from the schema count
    every row as missing. One aggregation pass, unpivoted with ``stack``."""
    present = set(df.columns)
    aggs = [F.count("*").alias("total_records")]
    for f in fields:
        if f in present:
            aggs.append(F.count_if(F.col(f).isNull()).alias(f"m__{f}"))
        else:
            aggs.append(F.count("*").alias(f"m__{f}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{f}', `m__{f}`" for f in fields)
    long = wide.selectExpr("total_records", f"stack({len(fields)}, {pairs}) as (field, missing)")
    w = Window.partitionBy(F.lit(1))  # at most len(fields) rows: one tiny group
    return long.withColumn("schema_valid", F.max(F.col("missing")).over(w) == 0)


def integrity_report(df: DataFrame, dataset: str, split: str, id_col: str, order_col: str,
                     required: Sequence[str], expected_count: int | None = None) -> DataFrame:
    """One row per check for a split; ``passed`` = all checks pass."""
    dup = check_duplicates(df, id_col, order_col).select(
        F.lit("duplicates").alias("check"), (~F.col("has_duplicates")).alias("ok"),
        F.concat(F.lit("num_duplicates="), F.col("num_duplicates")).alias("detail"))
    req = check_required(df, required).groupBy().agg(
        F.min("schema_valid").alias("ok"),
        F.concat_ws(",", F.collect_list(F.when(F.col("missing") > 0, F.concat(F.col("field"), F.lit("="), F.col("missing"))))).alias("detail")
    ).select(F.lit("schema").alias("check"), "ok", "detail")
    parts = [dup, req]
    if expected_count is not None:
        cnt = df.agg(F.count("*").alias("n")).select(
            F.lit("count").alias("check"), (F.col("n") == expected_count).alias("ok"),
            F.concat(F.lit("actual="), F.col("n")).alias("detail"))
        parts.append(cnt)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    one = Window.partitionBy(F.lit(1))  # three rows at most
    return out.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "check", "ok", "detail",
                      F.bool_and("ok").over(one).alias("passed"))


def integrity_summary(reports: DataFrame) -> DataFrame:
    """Per dataset, splits passed/failed and the failing checks."""
    per_split = reports.groupBy("dataset", "split").agg(
        F.bool_and("ok").alias("passed"),
        F.concat_ws(";", F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check"))))).alias("errors"))
    return per_split.groupBy("dataset").agg(
        F.count_if("passed").alias("splits_passed"),
        F.count_if(~F.col("passed")).alias("splits_failed"),
        F.bool_and("passed").alias("passed"),
        F.concat_ws(";", F.sort_array(F.collect_list(F.when(F.col("errors") != "", F.concat(F.col("split"), F.lit(":"), F.col("errors")))))).alias("errors"))


def drop_empty(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop "" and NULL texts; whitespace-only text is kept (reference)."""
    return df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))


def queries_with_positives(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Keep queries that have at least one positive (left semi join)."""
    pos = qrels.filter(F.col("rel") > 0).select("query_id")
    return queries.join(pos, "query_id", "left_semi")


# fixed values: search request bounds
QUERY_MIN_CHARS, QUERY_MAX_CHARS = 1, 1000
K_MIN, K_MAX = 1, 100
RERANK_MIN, RERANK_MAX = 1, 200


def validate_requests(requests: DataFrame, query_col: str = "query", k_col: str = "k",
                      rerank_col: str = "rerank_top_k") -> DataFrame:
    """Add ``valid`` and the first failing ``reason`` (NULL when valid)."""
    q, k, r = F.col(query_col), F.col(k_col), F.col(rerank_col)
    reason = (F.when(q.isNull() | (F.length(q) < QUERY_MIN_CHARS), "query too short")
               .when(F.length(q) > QUERY_MAX_CHARS, "query too long")
               .when(k.isNull() | (k < K_MIN) | (k > K_MAX), "k out of range")
               .when(r.isNotNull() & ((r < RERANK_MIN) | (r > RERANK_MAX)), "rerank_top_k out of range"))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def split_valid(requests: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    v = validate_requests(requests, **kw)
    return v.filter("valid").drop("reason", "valid"), v.filter(~F.col("valid"))


def binarize(qrels: DataFrame, threshold: int = 1, rel_col: str = "rel") -> DataFrame:
    """Graded relevance -> 0/1 at a threshold."""
    return qrels.withColumn(rel_col, (F.col(rel_col) >= threshold).cast("int"))


# fixed values: encode request bounds (texts per request)
ENCODE_MIN_TEXTS, ENCODE_MAX_TEXTS = 1, 100


def validate_encode_requests(requests: DataFrame, texts_col: str = "texts") -> DataFrame:
    """D1 request bounds: 1..100 texts per encode request; adds ``reason``
    and ``valid`` (batch encoding of a whole corpus has no such bound)."""
    n = F.size(F.col(texts_col))
    reason = (F.when(F.col(texts_col).isNull() | (n < ENCODE_MIN_TEXTS), "too few texts")
               .when(n > ENCODE_MAX_TEXTS, "too many texts"))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
