"""The two resident steps over a store: raw posts to normalized messages, and those to mentions. Doing either again adds nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, spread
from ..sources.keyed_table import KeyedTable
from ..sources.schemas import KEYS, SCHEMAS
from . import extract as x
from . import fingerprints as fp
from . import keyed
from . import normalize as n
from .hotness import at

#: bits of a message's id that are its raw id; its source's number stands above them
RAW_BITS = 56


@dataclass
class Store:
    """Normalized messages and entity mentions as keyed tables of one folder."""

    messages: KeyedTable
    mentions: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, parts: int = 16) -> Store:
        return cls(*(KeyedTable(spark, f"{path}/{t}", SCHEMAS[t], KEYS[t], parts=parts) for t in ("normalized_messages", "entity_mentions")))


def message_id(raw_source: Column, raw_id: Column) -> Column:
    """An id that follows from the key alone, so that a repeated run gives the same one and nobody counts rows."""
    number = F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(n.SOURCES) for v in (s, i)]), raw_source)
    return F.shiftleft(number.cast("long"), RAW_BITS) + raw_id


def ingest(store: Store, posts: DataFrame, hours: int = 24, radius: int = 3, batch: int | None = None) -> int:
    """Take the posts (``normalize.all_posts``) that the store has not seen; how many messages went in.

    Blank posts give none.  Each is held against the fingerprints of the ``hours`` before it, those of
    the store and of the batch: the messages that have one near are stored too, as its duplicates.
    """
    fresh = n.unseen(posts, store.messages.read(), batch)
    rows = n.normalized_rows(fresh, "created_at").withColumn("id", message_id(F.col("raw_source"), F.col("raw_id")))
    rows = cut(spread(rows, dealt=True).withColumn("simhash", fp.simhash64("text")), "fresh")
    ends = rows.agg(F.min("ts").alias("first"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return 0
    known = store.messages.read().where(F.col("ts") >= F.lit(ends["first"]) - F.expr(f"interval {hours + 1} hours")).select("id", "simhash", "ts")
    found = fp.duplicate_of(known.unionByName(rows.select("id", "simhash", "ts")), radius, hours)
    new = rows.join(found.withColumnRenamed("msg_id", "id"), "id", "left").withColumns(
        {"is_duplicate": F.col("dup_of").isNotNull(), "sentiment_score": F.lit(None).cast("double"), "l1_processed_at": F.lit(None).cast("timestamp_ntz")}
    )
    store.messages.insert_ignore(new.select(*store.messages.read().columns))
    return ends["n"]


def extract(store: Store, vocab: x.Vocabulary, moment, kols: DataFrame | None = None, batch: int | None = None) -> int:
    """Mentions of the store's messages that are not processed, written by key, then those messages marked with ``moment``; how many they were.

    The mentions are written first: if the run dies between the two, the next one writes the same mentions again.
    """
    todo = cut(n.unprocessed(store.messages.read(), batch), "todo")
    count = todo.count()
    if count:
        store.mentions.upsert(x.mention_rows(todo, vocab, kols).select(*store.mentions.read().columns))
        store.messages.upsert(keyed.mark_processed(todo, todo.select("id"), at(moment)))
    return count
