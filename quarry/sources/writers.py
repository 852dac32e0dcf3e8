"""Writers and dataset preparation.

Every writer writes through Spark (so any shared filesystem the cluster
uses works) and keeps outputs partitioned by the column readers filter on.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import prepare
from quarry.operators.relational import bounded_rows, take_first

#: Rows of a report that may be rendered on the driver.
MAX_REPORT_ROWS = 10_000


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunk table as snappy Parquet, one directory per split (readers
    that filter on ``split`` prune the others). Overwriting replaces the
    splits that are written and leaves the others."""
    (chunks.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
           .partitionBy("split").parquet(path))


def write_splits(df: DataFrame, out_dir: str, dataset: str, version: str = "1",
                 split_col: str = "split", mode: str = "overwrite") -> DataFrame:
    """JSON lines per split plus a manifest table
    ``(dataset, version, split, path, num_samples)``; counts come from one
    aggregation, not from re-reading the files. Splits that aren't written
    keep their files and their rows of the manifest."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(split_col).json(os.path.join(out_dir, "data"))
    counts = df.groupBy(split_col).agg(F.count("*").alias("num_samples"))
    manifest = counts.select(
        F.lit(dataset).alias("dataset"), F.lit(version).alias("version"),
        F.col(split_col).alias("split"),
        F.concat(F.lit(os.path.join(out_dir, "data", f"{split_col}=")), F.col(split_col)).alias("path"),
        "num_samples")
    manifest.coalesce(1).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("split").json(os.path.join(out_dir, "manifest"))
    return manifest


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("dataset string, version string, split string, path string, num_samples long") \
                .json(os.path.join(out_dir, "manifest")).select("dataset", "version", "split", "path", "num_samples")


def build_embedding_table(corpus: DataFrame, encoder, path: str | None = None, id_col: str = "doc_id",
                          text_col: str = "text", max_docs: int | None = None,
                          dedupe_texts: bool = True, mode: str = "overwrite") -> DataFrame:
    """Encode a corpus into ``(id, embedding)`` and write it.

    Identical texts are encoded once (``dropDuplicates`` before the Python
    stage, joined back by a text hash) and ``max_docs`` keeps the first
    documents in id order (the reference's cap). Partitions replace the
    reference's 100 000-row pieces.
    """
    src = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if max_docs is not None:
        src = take_first(src, max_docs, ["id"])
    if dedupe_texts:
        keyed = src.withColumn("__h", F.sha2(F.coalesce("text", F.lit("")), 256))
        uniq = keyed.dropDuplicates(["__h"]).select(F.col("__h").alias("id"), "text")
        enc = encoder.encode(uniq).withColumnRenamed("id", "__h")
        out = keyed.select("id", "__h").join(enc, "__h").drop("__h")
    else:
        out = encoder.encode(src)
    if path is not None:
        out.write.mode(mode).parquet(path)
        return corpus.sparkSession.read.parquet(path)
    return out


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Metric table as JSON, and a Markdown rendering of it. The table
    is written whole; one of more than MAX_REPORT_ROWS rows is refused as
    Markdown instead of being cut."""
    metrics.write.mode(mode).json(path)
    rows = bounded_rows(metrics.sparkSession.read.schema(metrics.schema).json(path), MAX_REPORT_ROWS, "metric report")
    cols = metrics.columns
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    for r in rows:
        lines.append("| " + " | ".join(f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in cols) + " |")
    return "\n".join(lines)


def prepare_dataset(spark: SparkSession, qa_path: str, out_dir: str, split: str,
                    max_tokens: int = 512, stride: int = 80, layout: str = "arrays") -> DataFrame:
    """QA JSON lines -> passages -> chunks -> Parquet + a manifest row
    with the chunking parameters and the P7 counters."""
    from quarry.sources.readers import read_qa_jsonl

    qa = read_qa_jsonl(spark, qa_path, layout)
    passages = prepare.explode_passages(qa)
    chunks = prepare.chunk_documents(passages, max_tokens, stride,
                                     keep=("query_id", "query", "is_relevant"))
    chunks = prepare.stamp(chunks.withColumnRenamed("query", "query_text"), split)
    write_chunks(chunks, os.path.join(out_dir, "chunks"))
    written = spark.read.parquet(os.path.join(out_dir, "chunks")).filter(F.col("split") == split)
    summary = prepare.prep_summary(written).select(
        F.lit(split).alias("split"), "*", F.lit(max_tokens).alias("max_tokens"), F.lit(stride).alias("stride"),
        F.lit(json.dumps({"source": qa_path})).alias("meta"))
    summary.coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "manifest", f"split={split}"))
    return summary


#: Chunks of the preparation of whole datasets.
PREPARE_TOKENS, PREPARE_STRIDE = 1000, 160

PREPARED = ("dataset string, split string, kind string, file string, num_chunks long, num_queries long, num_docs long, "
            "max_tokens int, stride int, error string")


def prepare_corpus(spark: SparkSession, corpus_path: str, out_dir: str, split: str = "corpus",
                   max_tokens: int = PREPARE_TOKENS, stride: int = PREPARE_STRIDE) -> DataFrame:
    """P8, corpus form: corpus JSON lines -> title and text as one -> chunks (empty documents
    left out) -> Parquet; returns the counters of what was written."""
    from quarry.sources.readers import read_corpus_jsonl

    docs = read_corpus_jsonl(spark, corpus_path)
    # a title is kept beside the text that it begins
    whole = prepare.combine_title(docs.withColumn("own_title", F.coalesce("title", F.lit("")))).where("text IS NOT NULL AND length(text) > 0")
    chunks = prepare.chunk_documents(whole.withColumn("doc_id", F.coalesce("doc_id", F.lit(""))), max_tokens, stride, keep=("own_title",))
    chunks = prepare.stamp(chunks.withColumnRenamed("own_title", "title"), split)
    write_chunks(chunks, os.path.join(out_dir, "chunks"))
    return prepare.prep_summary(spark.read.parquet(os.path.join(out_dir, "chunks")).filter(F.col("split") == split).drop("query_id"))


def prepare_all(spark: SparkSession, catalog: dict[str, dict], out_dir: str,
                max_tokens: int = PREPARE_TOKENS, stride: int = PREPARE_STRIDE) -> DataFrame:
    """P8 for all datasets of a catalog: ``{name: {"kind": "qa" | "corpus", "layout": ..., "splits": {split: path}}}``.

    Each split is written below ``out_dir/name`` and gives one row of the manifest, with its
    counters or the error that stopped it; an error leaves the other splits alone. A split
    that is prepared again replaces its files and its row, those that aren't stay."""
    for name, d in catalog.items():
        for split, path in d["splits"].items():
            out, row = os.path.join(out_dir, name), {"num_chunks": None, "num_queries": None, "num_docs": None, "error": None}
            try:
                if d["kind"] == "qa":
                    done = prepare_dataset(spark, path, out, split, max_tokens, stride, d.get("layout", "arrays"))
                elif d["kind"] == "corpus":
                    done = prepare_corpus(spark, path, out, split, max_tokens, stride)
                else:
                    raise ValueError(f"unknown kind of dataset: {d['kind']}")
                row |= done.first().asDict()
            except Exception as e:  # noqa: BLE001  whatever stops a split is its row's error
                row["error"] = f"{type(e).__name__}: {e}".splitlines()[0][:500]
            values = (name, split, d["kind"], os.path.join(out, "chunks", f"split={split}"), row["num_chunks"], row["num_queries"], row["num_docs"], max_tokens, stride, row["error"])
            (spark.createDataFrame([values], PREPARED).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("dataset", "split").json(os.path.join(out_dir, "prepared")))
    return read_prepared(spark, out_dir)


def read_prepared(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest of ``prepare_all``, one row a split."""
    columns = [c.split(" ")[0] for c in PREPARED.split(", ")]
    return spark.read.schema(PREPARED).json(os.path.join(out_dir, "prepared")).select(*columns)


def prepared_reports(manifest: DataFrame) -> DataFrame:
    """The manifest as reports for C6: a split passes if it was prepared and has chunks."""
    return manifest.select("dataset", "split", F.explode(F.array(
        F.struct(F.lit("prepare").alias("check"), F.col("error").isNull().alias("ok"), F.coalesce("error", F.lit("")).alias("detail")),
        F.struct(F.lit("chunks").alias("check"), (F.coalesce("num_chunks", F.lit(0)) > 0).alias("ok"), F.concat(F.lit("num_chunks="), F.coalesce("num_chunks", F.lit(0))).alias("detail")),
    )).alias("r")).select("dataset", "split", "r.*")


def prepare_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   max_tokens: int = 512, stride: int = 80, available_now: bool = True, split: str = "train"):
    """The stateless preparation over newly arriving QA JSON files, with
    the columns of ``prepare_dataset``
    (file source -> passages -> chunks -> Parquet sink). The checkpoint must
    be on the shared filesystem (the cluster's ``spark.checkpoint.dir``)."""
    from quarry.sources.readers import _with_corrupt

    raw = (spark.readStream.schema(_with_corrupt(prepare.QA_SCHEMA))
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                .json(in_dir))
    qa = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record") \
            .withColumn("query_id", F.coalesce(F.col("query_id"), F.col("query"), F.lit("")))
    chunks = prepare.chunk_documents(prepare.explode_passages(qa), max_tokens, stride,
                                     keep=("query_id", "query", "is_relevant"))
    chunks = prepare.stamp(chunks.withColumnRenamed("query", "query_text"), split)
    w = (chunks.writeStream.format("parquet").option("path", out_dir).partitionBy("split")
               .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
