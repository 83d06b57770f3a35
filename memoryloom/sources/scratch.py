"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors share; a local master may do without.

    It is deleted when the session's JVM ends, since a lazy result may read it until then.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="memoryloom-")
        _file_system(spark, base).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(base))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


class Scratch:
    """Tables that a computation writes and reads again; at the end all go but those that keep() names, after a failure all."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.name = spark, name
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def path(self) -> str:
        self.paths.append(folder(self.spark, self.name))
        return self.paths[-1]

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df written as a table that stays for a lazy result, until the JVM ends."""
        path = folder(self.spark, self.name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
