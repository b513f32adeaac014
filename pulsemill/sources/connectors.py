"""Other ways in and out: a relational database, a folder of files as a stream, dictionaries of a folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# The dictionary files, each with the entity type of its entries, in order.
FILES = {"tickers": "ticker", "chains": "chain", "narratives": "narrative", "kols": "kol"}


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in ``parts`` ranges at once."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts))
    return r.load()


def write_jdbc(rows: DataFrame, url: str, name: str, mode: str = "append", parts: int = 16, **options: str) -> None:
    """Rows into a database table, over ``parts`` connections at most; within a connection in batches, each part in one transaction."""
    rows.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", "5000").options(**options).mode(mode).save()


def folder_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _yaml(path: str) -> object:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading dictionaries needs a YAML parser") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def vocabulary_rows(read: Callable[[str], object], kinds: dict[str, str] = FILES) -> list[tuple[int, str, str, str, str | None]]:
    """(ord, alias, name, entity_type, category) of the dictionaries ``read`` gives by name; every defect is an error.

    A dictionary is a mapping of names to nothing less than a mapping; its aliases are the name's
    own lower case, then ``aliases`` and ``keywords``, each once. No name and no alias may stand twice.
    """
    rows, names, aliases = [], {}, {}
    for file, kind in kinds.items():
        entries = read(file)
        if entries is None:
            continue
        if not isinstance(entries, dict):
            raise ValueError(f"{file}: not a mapping")
        for name, entry in entries.items():
            if not isinstance(entry, dict):
                raise ValueError(f"{file}: {name} is no mapping")
            if name in names:
                raise ValueError(f"{name} stands in {names[name]} and in {file}")
            names[name] = file
            own = [name]
            for field in ("aliases", "keywords"):
                more = entry.get(field) or []
                if not isinstance(more, list):
                    raise ValueError(f"{file}: {field} of {name} is no list")
                own += more
            for alias in dict.fromkeys(str(a).lower() for a in own):
                if aliases.setdefault(alias, name) != name:
                    raise ValueError(f"alias {alias!r} of {aliases[alias]} and of {name}")
                rows.append((len(rows), alias, name, kind, entry.get("type")))
    return rows


def load_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionaries of a folder as the ``vocab`` table; a missing file is an error, an empty one is not."""
    rows = vocabulary_rows(lambda name: _yaml(os.path.join(folder, f"{name}.yaml")))
    return spark.createDataFrame(rows, "ord int, alias string, name string, entity_type string, category string").selectExpr("*", "1.0D as weight")

