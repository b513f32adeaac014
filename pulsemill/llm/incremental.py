"""New batches against all that was accepted before, without reading the history again (problem 6).

An ``AcceptedIndex`` is a folder that outlives the session that made it (``create``, ``open``):

* forms: (g, h, rep, s0, s1, form), one row for each accepted key form: g the upper 40 bits of its
  hash h, rep its smallest id, s0 and s1 its sketch;
* bands: (key, g), the band keys of each form, no more than ``shard`` forms to a key;
* hot: (key, chunk, g), what a key has beyond that, in chunks of ``shard`` that go on being
  numbered over all appends; heat: (key, n), how many an append put there;
* index.json: the layout, the number of the next append and of those that failed half-way.

forms and bands lie in ``slots`` folders by the rest of their hash, and in each of them in files
bucketed and sorted by it.  A probe reads the slots that the batch's keys fall in and shuffles the
batch, never the index.  Of the forms that share a band key with a record of the batch first the
sketches are fetched, in the same way by hash, then the forms of those that are near; the history's
texts are not read at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, discard, fresh_path, make_folder, read_text, spread, tasks, write_text
from . import minhash as mh
from .neardup import SHARD, band_keys, candidate_links, verified
from .textform import key_form

_COLUMNS = {"forms": "g bigint, h bigint, rep bigint, s0 bigint, s1 bigint, form string", "bands": "key bigint, g bigint", "hot": "key bigint, chunk int, g bigint", "heat": "key bigint, n bigint"}
_BUCKETED = {"forms": "g", "bands": "key", "hot": "key, chunk"}
#: bits of a hash that band rows do without: what they confuse is told apart by the forms
_SHORTER = 24
_PACKED = "'compression' = 'zstd', 'parquet.writer.version' = 'PARQUET_2_0', 'parquet.enable.dictionary' = 'false'"  # sorted keys are stored as differences


def printed(texts: DataFrame, id_col: str = "id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(id, h, form) of every row with an id and a key form of LEAST_LETTERS or more; others are no cases.

    With ``distinct`` only the smallest id of each form of an Arrow batch is given: what the index keeps of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [key_form(t) for t in b["text"]]
            keep = [i for i, k in enumerate(forms) if len(k) >= mh.LEAST_LETTERS]
            forms = [forms[i] for i in keep]
            out = pd.DataFrame({"id": b["id"].to_numpy()[keep], "h": np.array([mh.text_hash(k) for k in forms], np.int64), "form": pd.Series(forms, dtype=object)})
            yield out.sort_values("id", kind="stable").drop_duplicates("h") if distinct else out

    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return spread(rows).mapInPandas(run, "id long, h long, form string")


def _classes(prints: DataFrame) -> DataFrame:
    """(h, rep, form): one row for each form, rep its smallest id."""
    return prints.groupBy("h").agg(F.min(F.struct("id", "form")).alias("m")).select("h", F.col("m.id").alias("rep"), F.col("m.form").alias("form"))


def _signed(own: DataFrame, scheme: mh.Scheme) -> DataFrame:
    """(g, h, rep, s0, s1, form, keys) of (h, rep, form): the sketch, and the band keys packed."""
    head = mh.SIZE // 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                blobs = mh.blobs(b["form"].tolist(), scheme)
                words = np.frombuffer(b"".join(x[:head] for x in blobs), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"g": b["h"].to_numpy() >> _SHORTER, "h": b["h"], "rep": b["rep"], "s0": words[:, 0], "s1": words[:, 1], "form": b["form"], "blob": blobs})

    return own.select("h", "rep", "form").mapInPandas(run, "g long, h long, rep long, s0 long, s1 long, form string, blob binary")


class AcceptedIndex:
    """Band keys and forms of every accepted record, in a folder of their own."""

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.scheme, self.shard = mh.Scheme(*state["scheme"]), state["shard"]
        name = "accepted_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        self.tables = {kind: f"{name}_{kind}" for kind in _COLUMNS}
        for kind, table in self.tables.items():
            if not spark.catalog.tableExists(table):
                make_folder(spark, f"{self.path}/{kind}")
                slot, packed = (", slot int", f"{_PACKED}") if kind in _BUCKETED else ("", "'compression' = 'zstd'")
                layout = f"partitioned by (slot) clustered by ({_BUCKETED[kind]}) sorted by ({_BUCKETED[kind]}) into {state['buckets']} buckets" if slot else ""
                spark.sql(f"create table {table} ({_COLUMNS[kind]}, batch int{slot}) using parquet options ({packed}) {layout} location '{self.path}/{kind}'")
                if slot and state["next"]:
                    spark.sql(f"msck repair table {table}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int | None = None, slots: int = 4, shard: int = SHARD, scheme: mh.Scheme = mh.USUAL) -> AcceptedIndex:
        """An empty index in a new folder, which the cluster's executors must all reach."""
        if read_text(spark, f"{path}/index.json") is not None:
            raise ValueError(f"there is an index at {path}")
        index = cls(spark, path, {"buckets": buckets or tasks(spark), "slots": slots, "shard": shard, "scheme": [scheme.bands, scheme.rows, scheme.radius], "next": 0, "failed": []})
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AcceptedIndex:
        """The index that some earlier session left at ``path``."""
        text = read_text(spark, f"{path}/index.json")
        if text is None:
            raise ValueError(f"there is no index at {path}")
        state = json.loads(text)
        if state.pop("writing", False):  # an append that never ended: none of its rows count
            state["failed"].append(state["next"] - 1)
        return cls(spark, path, state)

    def _save(self, **more) -> None:
        write_text(self.spark, f"{self.path}/index.json", json.dumps(self.state | more))

    @property
    def empty(self) -> bool:
        return self.state["next"] == len(self.state["failed"])

    def read(self, kind: str, slots: list[int] | None = None) -> DataFrame:
        """A table's rows of whole appends, of the given slots only."""
        rows = self.spark.table(self.tables[kind]).where(F.col("batch") < self.state["next"])
        if self.state["failed"]:
            rows = rows.where(~F.col("batch").isin(self.state["failed"]))
        return rows if slots is None else rows.where(F.col("slot").isin(slots))

    def _slot(self, column: str):
        return F.pmod(F.col(column), F.lit(self.state["slots"])).cast("int")

    def _slots(self, rows: DataFrame, column: str) -> list[int]:
        """The slots that some value falls in: a row for each slot at most."""
        return sorted(r[0] for r in rows.select(self._slot(column)).distinct().collect())

    def _heat(self) -> DataFrame | None:
        """(key, n) of the hot keys, of which there is one for each ``shard`` rows of bands at most."""
        if not self.state.get("heated"):
            return None
        return self.read("heat").groupBy("key").agg(F.sum("n").alias("n"))

    def append(self, prints: DataFrame) -> None:
        """Add the classes of ``prints`` (``printed`` accepted records)."""
        number, buckets = self.state["next"], self.state["buckets"]
        before = not self.empty
        self.state["next"] = number + 1
        self._save(writing=True)
        tagged = lambda rows, column: rows.withColumns({"batch": F.lit(number), "slot": self._slot(column)})
        # one exchange brings equal forms together and lays them out as the table is bucketed
        least = prints.withColumn("g", F.shiftright("h", _SHORTER)).repartition(buckets, "g").groupBy("g", "h").agg(F.min(F.struct("id", "form")).alias("m"))
        new = cut(_signed(least.select("h", F.col("m.id").alias("rep"), F.col("m.form").alias("form")), self.scheme), "signed")
        tagged(new.drop("blob"), "g").write.insertInto(self.tables["forms"])
        keys = band_keys(new.select("g", "blob"), self.scheme, "g").repartition(buckets, "key")
        had = F.lit(0)
        if before:
            mine = keys.select("key").distinct()
            counts = mine.join(self.read("bands").where(F.col("batch") != number).select("key"), "key").groupBy("key").agg(F.count("*").alias("cold"))
            keys = keys.join(counts, "key", "left")
            had = F.coalesce(F.col("cold"), F.lit(0))
            heat = self._heat()
            if heat is not None:
                keys = keys.join(heat, "key", "left")
                had = had + F.coalesce(F.col("n"), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("g")) + had
        over = Observation()
        keys = keys.withColumn("chunk", F.floor((nth - 1) / self.shard).cast("int")).select("key", "g", "chunk")
        seen = keys.observe(over, F.count_if(F.col("chunk") > 0).alias("n"))
        tagged(seen.where("chunk = 0").select("key", "g"), "key").write.insertInto(self.tables["bands"])
        heated = over.get["n"]
        if heated:
            hot = cut(keys.where("chunk > 0"), "hot")
            tagged(hot.select("key", "chunk", "g").repartition(self.state["buckets"], "key", "chunk"), "key").write.insertInto(self.tables["hot"])
            hot.groupBy("key").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.insertInto(self.tables["heat"])
        self.state["heated"] = bool(self.state.get("heated") or heated)
        self._save()
        discard(new)

    def probe(self, own: DataFrame) -> DataFrame:
        """(g, h): the shorter hash of a form of the index and the hash of a form of ``own`` (``_signed``) that share a band key."""
        keys = cut(band_keys(own, self.scheme, "h"), "keys")
        hits = keys.join(self.read("bands", self._slots(keys, "key")).select("key", "g"), "key").select("g", "h")
        heat = self._heat()
        if heat is not None:
            sent = keys.join(heat, "key").withColumn("chunk", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / self.shard).cast("int"))))
            hits = hits.unionByName(sent.join(self.read("hot").select("key", "chunk", "g"), ["key", "chunk"]).select("g", "h"))
        return hits.distinct()

    def alike(self, own: DataFrame, least: float) -> DataFrame:
        """(h, rep): for each form of ``own`` (``_signed``) the smallest id of an equal or alike form of the index."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.loc[mh.alike_each(b["fa"].tolist(), b["fb"].tolist(), least), ["h", "rep"]]

        pairs = cut(self.probe(own), "met")
        forms = self.read("forms", self._slots(pairs, "g"))
        apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
        # the batch's sketches as a table of their own: by its size Spark sees whether to send them to the pairs or the pairs to them
        mine = cut(own.select("h", F.col("s0").alias("t0"), F.col("s1").alias("t1")), "mine")
        near = pairs.join(forms.select("g", F.col("h").alias("a"), "s0", "s1"), "g").join(mine, "h").where(apart <= self.scheme.radius)
        near = cut(near.select("g", "a", "h"), "near")
        # by g alone, as forms is bucketed: equality of the whole hashes as a second key would move it
        held = forms.select("g", F.col("h").alias("b"), "rep", F.col("form").alias("fa"))
        met = near.join(held, "g").where("a ^ b = 0").join(own.select("h", F.col("form").alias("fb")), "h")
        return met.select("h", "rep", "fa", "fb").mapInPandas(run, "h long, rep long").groupBy("h").agg(F.min("rep").alias("rep"))


def repeats(index: AcceptedIndex, batch: DataFrame, id_col: str = "id", text_col: str = "text", least: float = mh.SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The batch's repeats (orig_id, dup_id), and its ``printed`` rows.

    ``orig_id`` is the smallest id, below the record's own, of an alike record in the index or in
    the batch.  Null ids and texts and texts under LEAST_LETTERS are no cases; a repeated row
    counts once; other columns are not read; an empty batch or index gives no rows.
    """
    prints = cut(printed(batch, id_col, text_col), "batch")
    own = cut(_signed(_classes(prints), index.scheme), "own")
    links = verified(candidate_links(own.select("rep", "blob"), index.scheme), own.select(F.col("rep").alias("id"), F.col("form").alias("text")), least, formed=True)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the smallest id that each form may repeat: its own class's, that of an alike class of the batch, or one of the index
    best = own.select("h", "rep").unionByName(both.join(own.select(F.col("rep").alias("b"), "h"), "b").select("h", F.col("a").alias("rep")))
    if not index.empty:
        best = best.unionByName(index.alike(own, least))
    best = best.groupBy("h").agg(F.min("rep").alias("orig_id"))
    found = prints.select(F.col("id").alias("dup_id"), "h").join(best, "h").where("orig_id < dup_id")
    return found.groupBy("dup_id").agg(F.min("orig_id").alias("orig_id")).select("orig_id", "dup_id"), prints


def take_batch(index: AcceptedIndex, batch: DataFrame, **how) -> DataFrame:
    """``repeats`` of the batch, written; the records that repeat nothing are then appended to the index."""
    found, prints = repeats(index, batch, **how)
    found = cut(found, "repeats")
    index.append(prints.join(found.select(F.col("dup_id").alias("id")), "id", "left_anti"))
    return found


def unprocessed_repeats(messages: DataFrame, path: str | None = None) -> DataFrame:
    """(orig_id, dup_id): each message not yet processed that is alike to one with a smaller id, and the smallest such id; those that repeat nothing join the index.

    The index of the processed messages is made at ``path`` (in the shared folder, for this process
    only, if none is given); one that lies there already is opened and they are not read.
    """
    spark = messages.sparkSession
    if path is not None and read_text(spark, f"{path}/index.json") is not None:
        index = AcceptedIndex.open(spark, path)
    else:
        index = AcceptedIndex.create(spark, path or fresh_path(spark, "accepted"))
        index.append(printed(messages.where("l1_processed_at is not null"), distinct=True))
    return take_batch(index, messages.where("l1_processed_at is null"))
