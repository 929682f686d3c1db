"""Tables written to the shared checkpoint folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.store import shared_dir

#: Spark's setting by which the shuffle files of a query go as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of intermediate Parquet tables for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table, whose rows no longer depend on how they were made.

        Nothing reads the shuffles of the write again, so their files are removed with its end.
        """
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no plan reads any more, because what was made from them has been written."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spare_prefix(columns: list[str], prefix: str = "_w_") -> str:
    """A prefix that none of the columns has, for columns that an operator adds for a while."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def lower_ascii(text):
    """Lower-case A-Z only; null is empty. Texts without other letters take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= 500:
        spark.conf.set(key, "500")
