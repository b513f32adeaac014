"""Hourly figures of a stream, corrected as late records arrive: the trees of ``operators.late_events`` as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.late_events import HOUR, FingerBTree

#: hours of event time under one key
BLOCK = 24


def corrected_hours(events: DataFrame, source: str = "raw_source", ts: str = "ts", arrived: str = "created_at", value: str = "engagement", lateness_hours: int = 24) -> DataFrame:
    """(source, period, arrival, added, n, total) of a stream: an hour's figures after each hour of arrival of a batch that raises them.

    Keyed by source and day of event time, so a source is many keys; a key's partials are kept as its
    state between batches and go with it when no record of that day can be in time any more.  Rows that
    arrive ``lateness_hours`` or more after their hour's end are left out.  Records that were fetched
    twice are to be removed before (``windows.first_arrivals``).  An hour of arrival whose rows come in
    several batches gives a row for each.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tree = FingerBTree()
        for period, n, total in state.get[0] if state.exists else []:
            tree.add(period, n, total)
        rows = pd.concat(list(frames), ignore_index=True)
        hourly = rows.groupby(["arrival", "period"])["v"].agg(["size", "sum"]).reset_index().sort_values(["arrival", "period"])
        out = []
        for arrival, period, n, v in hourly.itertuples(index=False):
            now = tree.add(int(period), int(n), int(v))
            out.append((key[0], period, arrival, n, now[0], now[1]))
        state.update(([{"period": p, "n": n, "total": t} for p, (n, t) in tree.items()],))
        end = (int(key[1]) + 1) * BLOCK + lateness_hours
        state.setTimeoutTimestamp(max(end * HOUR * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "period", "arrival", "added", "n", "total"])

    hour = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / HOUR)
    rows = events.withColumn("t", F.col(arrived).cast("timestamp")).withWatermark("t", "1 hour").where(F.col(ts).isNotNull() & F.col("t").isNotNull())
    rows = rows.select(F.col(source).alias("source"), "t", hour(ts).alias("period"), hour(arrived).alias("arrival"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))
    rows = rows.where(F.col("arrival") <= F.col("period") + lateness_hours).withColumn("day", F.floor(F.col("period") / BLOCK))
    return rows.groupBy("source", "day").applyInPandasWithState(run, "source string, period long, arrival long, added long, n long, total long", "hours array<struct<period: long, n: long, total: long>>", "append", GroupStateTimeout.EventTimeTimeout)
