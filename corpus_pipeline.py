"""A corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark
decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet in the shared folder and rereads it as the next one's docs.

Rows that share a doc_id and a text are one document to the near-duplicate stage; where they
share only the doc_id, each text stays or goes by itself. Rows without doc_id are kept there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import op1_minhash_dedup, op4_decontaminate, op8_byte_bpe, op9_quality_rules, op10_pii
from quarry.llm.common import Scratch, free, small_batches
from quarry.session import ship_package


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def _with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    """The columns of docs with another text, and n_chars counted anew where it changes."""
    own = free("__new", changed.columns)
    new = changed.withColumn(own, text)
    n = {"n_chars": F.when(F.col(own) == F.col("text"), F.col("n_chars")).otherwise(F.length(own)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return new.withColumns(n).withColumn("text", F.col(own)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the lines that fail go."""
    _ready(spark)
    p = "__"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    judged = op9_quality_rules.quality(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), keep=docs.columns, prefix=p)
    # a filter that were pushed below the columns it reads would work all rules out a second time; it isn't
    # pushed past a column that isn't deterministic
    judged = judged.withColumn(p + "row", F.monotonically_increasing_id()).where(F.col(p + "kept") & (F.col(p + "row") >= 0))
    return _with_text(docs, judged, F.when(F.col(p + "share_left") == 1, F.col("text")).otherwise(F.col(p + "cleaned")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    _ready(spark)
    key, nth = free("__key", docs.columns), free("__nth", docs.columns)
    ids = op1_minhash_dedup.one_of_each(docs).withColumnRenamed("key", key)
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64(F.col("text").cast("string")))
    equal = Window.partitionBy("doc_id", key).orderBy(F.xxhash64("text"))
    one = keyed.join(ids, ["doc_id", key], "left_semi").withColumn(nth, F.row_number().over(equal)).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(docs.where("doc_id IS NULL").select(*columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _ready(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = free("__leaks", docs.columns)
    return op4_decontaminate.mark(docs, items, found).where(F.size(found) == 0).drop(found)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by the name of their kind."""
    _ready(spark)
    found = op10_pii.find(docs, op10_pii.train(docs), keep=docs.columns)
    return _with_text(docs, found, F.col(free("__redacted", docs.columns)))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the ids, their number and digest, and the digest of the decoded bytes;
    these take the place of columns of documents that have their names."""
    _ready(spark)
    docs = docs.drop("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    # workers that the stages before have used hold memory already, so that these remember less than op8's own
    return op8_byte_bpe.with_digests(op8_byte_bpe.decode(op8_byte_bpe.encode(docs, remembered=300_000)))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: Neither the near-duplicates' components, nor the boosted trees, nor BPE can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    _ready(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
