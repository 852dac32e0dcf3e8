"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

#: White space of the word rules: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


class Scratch:
    """Tables written below the shared folder that ``spark.checkpoint.dir`` names.

    A table that is written and read again cuts the lineage and survives the
    loss of executors. ``drop`` removes tables that no later read needs; those
    that the returned DataFrame reads stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows in an Arrow batch. Texts may be long, so batches are kept short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns can't clash with those that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free(name: str, columns) -> str:
    """The name, with as many underscores in front as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text):
    """A-Z to a-z. ``lower`` maps one character outside ASCII, the Kelvin sign, to an ASCII letter; it goes to another letter first."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
