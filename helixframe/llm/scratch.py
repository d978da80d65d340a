"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet to ``spark.checkpoint.dir``: a lost executor
loses nothing that was written, and a retried task reads the same rows again.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans.store import clear as clear
from helixframe.plans.store import delete, new_folder
from helixframe.plans.store import shared_dir as shared_dir


class Scratch:
    """A uniquely named folder of tables that one operator call writes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self._count = 0

    def path(self, label: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return it read back."""
        where = self.path(label)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._helixframe_path = where
        return out

    def keep_bucketed(self, df: DataFrame, label: str, column: str) -> DataFrame:
        """Like ``keep``, dealt out by ``column``: joins by it read the table where it lies and shuffle the other side alone."""
        where, name = self.path(label), f"helixframe_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, column).sortBy(column).format("parquet").option("path", where).saveAsTable(name)
        out = self.spark.table(name)
        out._helixframe_path, out._helixframe_table = where, name
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if hasattr(df, "_helixframe_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {df._helixframe_table}")
            self.remove(df._helixframe_path)

    def remove(self, where: str) -> None:
        delete(self.spark, where)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Fewer rows in an Arrow batch, for jobs that run inside and hand whole texts to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), rows) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
