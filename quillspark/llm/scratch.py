"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session without executors of its own may do without: it gets a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Writes tables below one new folder; `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` written once and read again: its lineage is cut, and later readers agree on its rows."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes the files of tables that `keep` returned; tables made from them must have been written before."""
        jvm, kept = self.spark._jvm, []
        for df, path in self.paths:
            if any(df is t for t in tables):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            else:
                kept.append((df, path))
        self.paths = kept

    def settle(self) -> None:
        """Plans, broadcasts and shuffle files of steps that are over go at once, and the driver's heap shrinks to what is still in
        use; else they stay until it happens to be full. For loops of many jobs."""
        gc.collect()  # what Python holds of them first
        self.spark._jvm.System.gc()
