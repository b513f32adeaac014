"""Per-hour aggregates by event time, corrected as late records arrive, up to a cut-off (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import instant, tasks

HOUR = 3600
#: entries of a leaf and children of an inner node, at most
WIDTH = 16
#: hours of event time whose trees one task holds at once
BLOCK_HOURS = 24 * 7


class _Node:
    __slots__ = ("keys", "below", "parent", "n", "total")

    def __init__(self, keys: list[int], below: list | None, parent: _Node | None) -> None:
        #: of a leaf: periods and their partials; of an inner node: the least key below each child, and the children
        self.keys, self.below, self.parent = keys, below, parent
        self.n = self.total = 0

    @property
    def leaf(self) -> bool:
        return not self.below or not isinstance(self.below[0], _Node)


class FingerBTree:
    """B-tree of (count, sum) partials keyed by period, with a finger on its newest leaf.

    An insert starts at the finger and climbs only as far as the ancestor that covers its key, so
    records in order cost O(1) and a record late by d periods O(log d); partials of the ancestors
    are brought up to date on the way to the root.  ``evict`` unlinks whole subtrees of old
    periods and walks only the path along the cut.
    """

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.root = self.finger = _Node([], [], None)

    def __len__(self) -> int:
        def count(x: _Node) -> int:
            return len(x.keys) if x.leaf else sum(map(count, x.below))

        return count(self.root)

    def add(self, period: int, n: int, total: int) -> tuple[int, int]:
        """Add to a period's partial; what it is now."""
        at = self.finger
        while at.parent is not None and (not at.keys or period < at.keys[0]):
            at = at.parent
        while not at.leaf:
            at = at.below[max(0, self._place(at.keys, period) - 1)]
        i = self._place(at.keys, period)
        if i and at.keys[i - 1] == period:
            had = at.below[i - 1]
            now = at.below[i - 1] = (had[0] + n, had[1] + total)
        else:
            at.keys.insert(i, period)
            at.below.insert(i, (n, total))
            now = (n, total)
        up: _Node | None = at
        while up is not None:
            up.n += n
            up.total += total
            if up.parent is not None and up.keys[0] < up.parent.keys[0] and up.parent.below[0] is up:
                up.parent.keys[0] = up.keys[0]
            up = up.parent
        if len(at.keys) > self.width:
            self._split(at)
        return now

    def items(self) -> list[tuple[int, tuple[int, int]]]:
        """Periods with their partials, in order."""

        def below(x: _Node) -> list:
            return list(zip(x.keys, x.below)) if x.leaf else [y for c in x.below for y in below(c)]

        return below(self.root)

    def total(self) -> tuple[int, int]:
        return self.root.n, self.root.total

    def since(self, period: int) -> tuple[int, int]:
        """The total of all periods from ``period`` on: whole subtrees count by their partial."""
        n = total = 0
        at = self.root
        while not at.leaf:
            i = max(0, self._place(at.keys, period) - 1)
            for x in at.below[i + 1 :]:
                n, total = n + x.n, total + x.total
            at = at.below[i]
        for k, p in zip(at.keys, at.below):
            if k >= period:
                n, total = n + p[0], total + p[1]
        return n, total

    def evict(self, before: int) -> None:
        """Drop all periods below ``before``."""
        at, path = self.root, []
        while True:
            path.append(at)
            if at.leaf:
                i = self._place(at.keys, before - 1)
                del at.keys[:i], at.below[:i]
                break
            i = max(0, self._place(at.keys, before - 1) - 1)
            del at.keys[:i], at.below[:i]
            at = at.below[0]
        for x in reversed(path):
            if not x.leaf:
                if not x.below[0].keys:
                    del x.keys[0], x.below[0]
                else:
                    x.keys[0] = x.below[0].keys[0]
            self._sum(x)
        while not self.root.leaf and len(self.root.below) == 1:
            self.root = self.root.below[0]
            self.root.parent = None
        if not self.root.keys:
            self.root = _Node([], [], None)
        at = self.root
        while not at.leaf:
            at = at.below[-1]
        self.finger = at

    @staticmethod
    def _place(keys: list[int], period: int) -> int:
        """How many keys are not above ``period``."""
        lo, hi = 0, len(keys)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if keys[mid] <= period else (lo, mid)
        return lo

    @staticmethod
    def _sum(x: _Node) -> None:
        if x.leaf:
            x.n, x.total = sum(p[0] for p in x.below), sum(p[1] for p in x.below)
        else:
            x.n, x.total = sum(c.n for c in x.below), sum(c.total for c in x.below)

    def _split(self, x: _Node) -> None:
        half = len(x.keys) // 2
        y = _Node(x.keys[half:], x.below[half:], x.parent)
        del x.keys[half:], x.below[half:]
        if not y.leaf:
            for c in y.below:
                c.parent = y
        self._sum(x)
        self._sum(y)
        if x is self.finger:
            self.finger = y
        if x.parent is None:
            self.root = _Node([x.keys[0], y.keys[0]], [x, y], None)
            x.parent = y.parent = self.root
            self._sum(self.root)
            return
        at = x.parent.below.index(x) + 1
        x.parent.keys.insert(at, y.keys[0])
        x.parent.below.insert(at, y)
        if len(x.parent.keys) > self.width:
            self._split(x.parent)


def _corrections(lateness: int):
    """Over (source, block, arrival, period, n, total) sorted by the first four: each row with the period's figures after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, clock = None, FingerBTree(), None
        for b in batches:
            out = []
            for source, block, arrival, period, n, total in zip(*(b[c].tolist() for c in ("source", "block", "arrival", "period", "n", "total"))):
                if (source, block) != at:
                    at, tree, clock = (source, block), FingerBTree(), None
                if arrival != clock:
                    tree.evict(arrival - lateness)  # these may not be corrected any more
                    clock = arrival
                now = tree.add(period, n, total)
                out.append((source, period, arrival, n, now[0], now[1]))
            yield pd.DataFrame(out, columns=["source", "period", "arrival", "added", "n", "total"])

    return run


def _trailing(lateness: int, hours: int):
    """Over rows as ``_corrections`` takes them, a source together: (source, arrival, n, total) of the last ``hours`` after each hour of arrival."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, clock = None, FingerBTree(), None

        def figures() -> tuple:
            (n, total), (ahead, more) = tree.since(clock - hours + 1), tree.since(clock + 1)
            return at[0], clock, n - ahead, total - more

        for b in batches:
            out = []
            for source, arrival, period, n, total in zip(*(b[c].tolist() for c in ("source", "arrival", "period", "n", "total"))):
                if (source,) != at or arrival != clock:
                    if at is not None:
                        out.append(figures())
                    if (source,) != at:
                        at, tree = (source,), FingerBTree()
                    clock = arrival
                    tree.evict(arrival - lateness)
                tree.add(period, n, total)
            yield pd.DataFrame(out, columns=["source", "arrival", "n", "total"])
        if at is not None:
            yield pd.DataFrame([figures()], columns=["source", "arrival", "n", "total"])

    return run


def _hourly(events: DataFrame, source: str, record: str | None, ts: str, arrived: str, value: str, lateness_hours: int) -> DataFrame:
    """(source, period, arrival, n, total) of the records in time, each counted at its first arrival."""
    hour = lambda c: F.floor(F.unix_seconds(instant(c)) / HOUR)
    rows = events.select(F.col(source).alias("source"), (F.col(record) if record else F.lit(None)).alias("r"), F.col(arrived).alias("at"), F.col(ts).alias("ts"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))
    rows = rows.where("ts is not null and at is not null")
    once = rows.where("r is not null").groupBy("source", "r").agg(F.min(F.struct("at", "ts", "v")).alias("m")).select("source", "m.at", "m.ts", "m.v")
    rows = once.unionByName(rows.where("r is null").select("source", "at", "ts", "v"))
    rows = rows.select("source", hour("ts").alias("period"), hour("at").alias("arrival"), "v").where(F.col("arrival") <= F.col("period") + lateness_hours)
    return rows.groupBy("source", "period", "arrival").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def corrected_hours(
    events: DataFrame, source: str = "raw_source", record: str | None = "raw_id", ts: str = "ts", arrived: str = "created_at", value: str = "engagement", lateness_hours: int = 24, block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """One row for each hour of arrival that raises an hour's figures of a source.

    (source, period, arrival, added, n, total): ``period`` and ``arrival`` as hours since 1970,
    the records that came in, and count and sum of ``value`` of the period after them.  A record
    that arrives ``lateness_hours`` or more after its hour's end is left out.

    Of equal (source, record) only the first arrival counts (ties by the earlier ts, then the
    smaller value); a null record is one of its own.  Rows with a null ts or arrival are left out;
    a null source is a source, a null value adds 0; records ahead of time count at their arrival.
    Other columns are not read; an empty table gives no rows.

    Rows are brought to one per source, period and hour of arrival, then spread by source and
    block of ``block_hours`` of event time, so that a source with most of the rows is many tasks' work.
    """
    hourly = _hourly(events, source, record, ts, arrived, value, lateness_hours)
    hourly = hourly.withColumn("block", F.floor(F.col("period") / block_hours))
    spread = hourly.repartition(tasks(events.sparkSession), "source", "block").sortWithinPartitions("source", "block", "arrival", "period")
    kinds = "source string, period long, arrival long, added long, n long, total long"
    return spread.select("source", "block", "arrival", "period", "n", "total").mapInPandas(_corrections(lateness_hours), kinds)


def trailing_at_arrival(
    events: DataFrame, hours: int = 24, source: str = "raw_source", record: str | None = "raw_id", ts: str = "ts", arrived: str = "created_at", value: str = "engagement", lateness_hours: int = 24
) -> DataFrame:
    """(source, arrival, n, total): after each hour of arrival, a source's figures over the ``hours`` of event time up to that hour, as known then.

    Read off the tree's partials: whole subtrees count by their own.  Rows as ``corrected_hours`` takes
    them; hours of arrival without a record give no row, hours ahead of the arrival do not count.  A
    source is one task's work here, after it was brought to a row for each period and hour of arrival,
    so what the task reads grows with the time the table spans and not with its rows.
    """
    if hours > lateness_hours + 1:
        raise ValueError("the hours asked for must not reach behind the cut-off")
    hourly = _hourly(events, source, record, ts, arrived, value, lateness_hours)
    rows = hourly.repartition(tasks(events.sparkSession), "source").sortWithinPartitions("source", "arrival", "period")
    return rows.select("source", "arrival", "period", "n", "total").mapInPandas(_trailing(lateness_hours, hours), "source string, arrival long, n long, total long")


def hour_text(hours: str):
    """'yyyy-MM-ddTHH' of a number of hours since 1970."""
    return F.date_format(F.timestamp_seconds(F.col(hours) * HOUR), "yyyy-MM-dd'T'HH")


def late_corrections(messages: DataFrame) -> DataFrame:
    """(raw_source, period_hour, arrival_hour): hours whose count a later hour of arrival raised."""
    c = corrected_hours(messages).where("arrival > period")
    return c.select(F.col("source").alias("raw_source"), hour_text("period").alias("period_hour"), hour_text("arrival").alias("arrival_hour"))
