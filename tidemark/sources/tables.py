"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and the session is local, a temporary folder kept for the session; on a
    cluster without it, an error, since executors would write where nobody else reads."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, through Hadoop's file system, so that any shared store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, deleted when it ends; what outlives it is written by `materialise`.

    >>> with Scratch(spark, "links") as scratch:
    ...     pairs = scratch.write(pairs, "pairs")
    ...     return materialise(verified(pairs), "links")
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.path}/{self.count}-{name}")

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch before its end."""
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(self.spark, folder)
