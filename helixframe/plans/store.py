"""Tables between the passes of an iterative operator, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that operators of this process have written, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  One of our own only where none is set and all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for one operator call; ``clear`` knows of it."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(root)
    return root


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete every folder that operators wrote in this application; returned frames that still read them fail from then on."""
    roots = _written.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        delete(spark, root)
    return len(roots)


#: Spark removes the shuffle files of a query as it ends, instead of when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Writes cut lineage, so a lost executor costs a task and not the loop so far.

    A pass on disk is read again instead of its shuffles, so these are removed
    as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self.count = 0
        self.last: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str, replace: bool = False) -> DataFrame:
        """``df`` from disk.  With ``replace`` the pass before of that label is deleted then: nothing may read it any longer."""
        self.count += 1
        where = f"{self.root}/{self.count:03d}-{label}"
        was = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(where)
        finally:
            self.spark.conf.set(_TIDY, was)
        if replace and label in self.last:
            delete(self.spark, self.last[label])
        self.last[label] = where
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, label: str) -> None:
        """Delete the last pass of that label, which nothing reads any longer."""
        delete(self.spark, self.last.pop(label))
