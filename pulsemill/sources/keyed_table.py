"""A table with unique keys in a folder that outlives the session: writes touch only the parts whose keys come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed
from ..session import delete, read_text, write_text

PART = "_part"


class KeyedTable:
    """Parquet rows in parts, a part in a version of its own; ``manifest.json`` says which version of which part is in force.

    ``by`` is an SQL expression over the key's columns that gives a row's part (a hash of the key into
    ``parts`` where there is none; say ``to_date(window_end)`` for snapshots).  A write reads the parts
    that its rows fall in, writes them anew beside the old ones and then replaces the manifest, in one
    step: whoever reads sees the table before or after, a write that dies leaves it as it was, and
    doing it again is safe.  One writer at a time.  Old versions stay readable until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], by: str | None = None, parts: int = 16) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.by = by or f"pmod(xxhash64({', '.join(f'`{k}`' for k in key)}), {parts})"

    def _manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/manifest.json")
        return json.loads(text) if text else {"version": 0, "parts": {}}

    def _rows(self, manifest: dict, parts: list[str] | None = None) -> DataFrame:
        at = [f"{self.path}/v{v}/{PART}={p}" for p, v in manifest["parts"].items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest())

    def _write(self, new: DataFrame, change) -> None:
        manifest = self._manifest()
        part = F.coalesce(F.expr(self.by).cast("string"), F.lit("null"))
        touched = sorted(r[0] for r in new.select(part.alias("p")).distinct().collect())  # parts, not rows
        if not touched:
            return
        version = manifest["version"] + 1
        rows = change(self._rows(manifest, touched), new, self.key).withColumn(PART, part)
        delete(self.spark, f"{self.path}/v{version}")  # of a write that died
        rows.repartition(PART, *(F.col(k) for k in self.key)).write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.path}/v{version}")
        manifest = {"version": version, "parts": manifest["parts"] | {p: version for p in touched}}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))

    def insert_ignore(self, new: DataFrame) -> None:
        """Rows whose key is not there; rows with a null in the key always go in."""
        self._write(new, keyed.insert_ignore)

    def upsert(self, new: DataFrame) -> None:
        """Rows in place of those of their key; of new rows with one key all go in, so they must be unique."""
        self._write(new, keyed.upsert)

    def vacuum(self) -> None:
        """Delete the versions of parts that are no longer in force."""
        manifest = self._manifest()
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for v in fs.listStatus(root):
            number = v.getPath().getName()[1:]
            if v.isDirectory() and number.isdigit():
                for p in fs.listStatus(v.getPath()):
                    name = p.getPath().getName()
                    if name.startswith(f"{PART}=") and manifest["parts"].get(name.split("=", 1)[1]) != int(number):
                        fs.delete(p.getPath(), True)

