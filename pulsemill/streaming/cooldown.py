"""The cool-down of repeated signals over a stream, each key's last passed signal held as its state."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cooldown import Cooldown, decide

FORGET = datetime.timedelta(days=30)


def passed(signals: DataFrame, c: Cooldown, key: str = "string", lateness: str = "1 hour", forget: datetime.timedelta = FORGET) -> DataFrame:
    """(key, at, growth, cross, why) of the signals of a stream that pass, as ``operators.cooldown.passed`` has them.

    A key's record is dropped once the watermark is ``forget`` past it; its next signal is a first one
    again.  A signal older than its key's record is held back: the record is already that of a later one.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        if state.exists:
            micros, growth, cross = state.get
            last = (pd.Timestamp(micros * 1000).to_pydatetime(), growth, cross)
        out = []
        for at, growth, cross in sorted(row for f in frames for row in zip(f["micros"].tolist(), f["growth"].tolist(), f["cross"].tolist())):
            when = pd.Timestamp(at * 1000).to_pydatetime()
            why = None if last is not None and when < last[0] else decide(last, when, growth, cross, c)
            if why is not None:
                last = (when, growth, cross)
                out.append((k[0], when, growth, cross, why))
        if last is not None:
            micros = int(pd.Timestamp(last[0]).value // 1000)
            state.update((micros, last[1], last[2]))
            state.setTimeoutTimestamp(max(micros // 1000 + int(forget.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "growth", "cross", "why"])

    rows = signals.withColumn("t", F.col("at").cast("timestamp")).withWatermark("t", lateness)
    rows = rows.select("key", "t", F.unix_micros("t").alias("micros"), F.col("growth").cast("double").alias("growth"), F.col("cross").cast("long").alias("cross")).where("key is not null and t is not null and growth is not null and cross is not null")
    return rows.groupBy("key").applyInPandasWithState(run, f"key {key}, at timestamp_ntz, growth double, cross long, why string", "micros long, growth double, cross long", "append", GroupStateTimeout.EventTimeTimeout)
