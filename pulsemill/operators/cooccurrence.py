"""Entity pairs of a time window with their association, and which of them are new."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .hotness import WINDOWS, at

# Windows that pairs may be counted over.
PAIR_WINDOWS = ("1h", "6h", "24h")


@dataclass(frozen=True)
class PairBoard:
    window: str = "24h"
    top_pairs: int = 100
    min_count: int = 3
    min_pmi: float = 1.0
    min_msgs: int = 50
    #: entities of a message that count, the first by name, as the board is defined; None for all of them
    most_entities: int | None = 10
    baseline_days: int = 7

    def __post_init__(self) -> None:
        if self.window not in PAIR_WINDOWS:
            raise ValueError(f"pairs are not counted over {self.window!r}")
        if self.min_count < 1 or self.top_pairs < 1:
            raise ValueError("min_count and top_pairs must be at least 1")


def pmi(c: Column, a: Column, b: Column, n: Column) -> Column:
    """Natural log of c over its chance; 0 where a count is none."""
    return F.when((c > 0) & (a > 0) & (b > 0) & (n > 0), F.ln(c / ((a * b) / n))).otherwise(0.0)


def window_mentions(mentions: DataFrame, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
    """(msg_id, entity), once each, of [start, end)."""
    return mentions.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end)) & F.col("msg_id").isNotNull() & F.col("entity").isNotNull()).select("msg_id", "entity").distinct()


def capped(rows: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` entities of each message, by name; all where it is None."""
    if most is None:
        return rows
    order = Window.partitionBy("msg_id").orderBy("entity")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def pairs_of(rows: DataFrame) -> DataFrame:
    """(entity_a, entity_b, n): messages with both; a message has at most as many entities as ``capped`` leaves."""
    sets = rows.groupBy("msg_id").agg(F.sort_array(F.collect_list("entity")).alias("s")).where(F.size("s") > 1)
    each = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as entity_a, y as entity_b))))")
    return sets.select(F.explode(each).alias("p")).groupBy("p.entity_a", "p.entity_b").agg(F.count("*").alias("n"))


def pair_board(mentions: DataFrame, end: datetime.datetime, b: PairBoard) -> DataFrame:
    """Ranked pairs of the window that ends at ``end``; none when it holds fewer than ``min_msgs`` messages."""
    start = end - datetime.timedelta(hours=WINDOWS[b.window])
    rows = window_mentions(mentions, start, end)
    total = rows.agg(F.count_distinct("msg_id").alias("n"))
    few = capped(rows, b.most_entities)
    counts = few.groupBy("entity").agg(F.count("*").alias("k"))
    found = pairs_of(few).where(F.col("n") >= b.min_count).withColumnRenamed("n", "cooccur_count")
    found = found.join(counts.select(F.col("entity").alias("entity_a"), F.col("k").alias("count_a")), "entity_a")
    found = found.join(counts.select(F.col("entity").alias("entity_b"), F.col("k").alias("count_b")), "entity_b").withColumn("total", total.scalar())
    found = found.withColumn("pmi", pmi(F.col("cooccur_count"), F.col("count_a"), F.col("count_b"), F.col("total")))
    found = found.where((F.col("pmi") >= b.min_pmi) & (F.col("total") >= b.min_msgs))
    return found.orderBy(F.desc("pmi"), "entity_a", "entity_b").limit(b.top_pairs).select(at(end).alias("window_end"), F.lit(b.window).alias("window_type"), "entity_a", "entity_b", "cooccur_count", "count_a", "count_b", "total", "pmi")


def with_new(board: DataFrame, mentions: DataFrame, end: datetime.datetime, b: PairBoard, least: int = 3) -> DataFrame:
    """``pair_board`` with is_new_pair: ``least`` messages in the window and none in the days before it.

    The board's ``top_pairs`` rows are written once; only the earlier messages that have the first
    entity of one of them are asked for the second.
    """
    start = end - datetime.timedelta(hours=WINDOWS[b.window])
    board = cut(board, "board")
    before = window_mentions(mentions, end - datetime.timedelta(days=b.baseline_days), start)
    wanted = board.select("entity_a", "entity_b").join(before.withColumnRenamed("entity", "entity_a"), "entity_a")
    known = wanted.join(before.withColumnRenamed("entity", "entity_b"), ["msg_id", "entity_b"], "left_semi").select("entity_a", "entity_b").distinct().withColumn("known", F.lit(True))
    return board.join(known, ["entity_a", "entity_b"], "left").withColumn("is_new_pair", (F.col("cooccur_count") >= least) & F.col("known").isNull()).drop("known")


def neighbors(board: DataFrame, entity: str, k: int) -> DataFrame:
    """(other, pmi, cooccur_count): the entity's partners on either side."""
    side = F.when(F.col("entity_a") == entity, F.col("entity_b")).otherwise(F.col("entity_a"))
    return board.where((F.col("entity_a") == entity) | (F.col("entity_b") == entity)).select(side.alias("other"), "pmi", "cooccur_count").orderBy(F.desc("pmi"), "other").limit(k)
