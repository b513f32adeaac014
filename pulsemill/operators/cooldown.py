"""Letting a repeated signal of a key through only when something about it changed, or after a while."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import tasks


@dataclass(frozen=True)
class Cooldown:
    quiet: datetime.timedelta = datetime.timedelta(minutes=60)
    heartbeat: datetime.timedelta = datetime.timedelta(hours=6)
    escalation: float = 1.5
    step: float = 0.0


FIRST, HEARTBEAT, ESCALATED, WIDER, GROWN, AGAIN = "first", "heartbeat", "escalated", "wider", "grown", "again"


def decide(last: tuple | None, at: datetime.datetime, growth: float, cross: int, c: Cooldown) -> str | None:
    """Why a signal passes, given (time, growth, cross) of the key's last one that did; None when it is held back."""
    if last is None:
        return FIRST
    elapsed = at - last[0]
    if elapsed >= c.heartbeat:
        return HEARTBEAT
    if last[1] > 0 and growth >= last[1] * c.escalation:
        return ESCALATED
    if cross > last[2]:
        return WIDER
    if c.step > 0 and last[1] > 0 and growth >= last[1] * (1 + c.step):
        return GROWN
    return None if elapsed < c.quiet else AGAIN


def decided(last_at: Column, last_growth: Column, last_cross: Column, at: Column, growth: Column, cross: Column, c: Cooldown) -> Column:
    """``decide`` as a column; a null ``last_at`` means no last signal."""
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1_000_000
    elapsed = seconds(at) - seconds(last_at)
    out = F.when(last_at.isNull(), FIRST).when(elapsed >= c.heartbeat.total_seconds(), HEARTBEAT)
    out = out.when((last_growth > 0) & (growth >= last_growth * c.escalation), ESCALATED).when(cross > last_cross, WIDER)
    if c.step > 0:
        out = out.when((last_growth > 0) & (growth >= last_growth * (1 + c.step)), GROWN)
    return out.when(elapsed >= c.quiet.total_seconds(), AGAIN)


def passed(signals: DataFrame, c: Cooldown) -> DataFrame:
    """(key, at, growth, cross, why) of the signals that pass; the record of a key is that of its last signal that did.

    ``signals`` has key, at, growth and cross; rows with a null in any of them are left out. A
    task walks its keys in the order of time and holds one record, whatever the key's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            why = []
            for k, at, growth, cross in zip(b["key"].tolist(), [t.to_pydatetime() for t in b["at"]], b["growth"].tolist(), b["cross"].tolist()):
                if k != key:
                    key, last = k, None
                w = decide(last, at, growth, cross, c)
                if w is not None:
                    last = (at, growth, cross)
                why.append(w)
            yield b.assign(why=why).dropna(subset=["why"])

    rows = signals.select("key", "at", F.col("growth").cast("double").alias("growth"), F.col("cross").cast("long").alias("cross")).dropna()
    kind = dict(rows.dtypes)
    spread = rows.repartition(tasks(signals.sparkSession), "key").sortWithinPartitions("key", "at", "growth", "cross")
    return spread.mapInPandas(run, f"key {kind['key']}, at {kind['at']}, growth double, cross long, why string")
