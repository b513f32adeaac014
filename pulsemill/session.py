"""Session helpers: the shared folder for cut lineage, small files in it, zone-safe timestamps, and dealing out rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset a temporary one in local mode (tests), on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pulsemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is deleted when this process ends."""
    if not _written:
        atexit.register(_forget)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written once to the shared folder and read from there: a lost executor costs nothing but a re-read."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pulsemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df`` before the process ends; nothing that is still to run may read it."""
    for entry in [e for e in _written if e[1] == df._pulsemill_path]:
        delete(*entry)
        _written.remove(entry)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one at ``path``, whole or not at all: it is written beside it and renamed over it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = new.getFileSystem(conf).create(new)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf)
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(p), over)


def _forget() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def instant(column: str | Column) -> Column:
    """A zone-less timestamp as the instant it names; sessions run in UTC."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("timestamp")


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the width asked for where an exchange is written out by hand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df``, rows as they are read from a table, for work that is heavy on each row: dealt out anew where it comes in fewer partitions than there are cores.

    A table of many files stays as it is read; only one of a few (which no more tasks could share) is moved.
    ``dealt`` says that the rows come out of an exchange already: they stay where they are.
    """
    if dealt:  # asking for its partitions would run the exchange
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
