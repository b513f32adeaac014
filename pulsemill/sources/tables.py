"""Reading the fixture tables, with the schema fixes every query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state_of(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, time of change) of a path's files: what tells whether a table read before is still the same."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)))
