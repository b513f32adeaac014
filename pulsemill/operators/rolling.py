"""Totals and averages over trailing periods, for each entity and day (problem 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tasks

#: output rows a task holds before it hands them on
HELD = 50_000

Partial = tuple[int, int, int | None]


def combine(a: Partial, b: Partial) -> Partial:
    """The monoid of (count, sum, max); a max of None is none yet."""
    top = b[2] if a[2] is None else a[2] if b[2] is None else max(a[2], b[2])
    return a[0] + b[0], a[1] + b[1], top


NOTHING: Partial = (0, 0, None)


class TwoStackQueue:
    """First-in-first-out window of (day, partial) with its total at hand, for any monoid, inverses not needed.

    ``back`` takes new values under one running total; ``front`` holds suffix totals, so its last
    element is the total of all of it.  Each value moves from one to the other once.
    """

    __slots__ = ("add", "zero", "front", "back", "back_total")

    def __init__(self, add: Callable = combine, zero=NOTHING) -> None:
        self.add, self.zero = add, zero
        self.clear()

    def clear(self) -> None:
        self.front, self.back, self.back_total = [], [], self.zero

    def push(self, day: int, value) -> None:
        self.back.append((day, value))
        self.back_total = self.add(self.back_total, value)

    def evict(self, before: int) -> None:
        """Drop what is of a day below ``before``; days come in rising."""
        while self.front or self.back:
            if not self.front:
                total = self.zero
                for day, value in reversed(self.back):
                    total = self.add(value, total)
                    self.front.append((day, total))
                self.back, self.back_total = [], self.zero
            if self.front[-1][0] >= before:
                return
            self.front.pop()

    def total(self):
        return self.add(self.front[-1][1], self.back_total) if self.front else self.back_total


def _windows(first: int, last: int, periods: tuple[int, ...], quiet: bool):
    """Over (entity, day, n, total, top) sorted by entity and day: a row for each entity and day from ``first`` to ``last``.

    Without ``quiet`` days on which even the longest period is empty are left out.
    """
    names = ["entity", "day", "n", *(f"{c}_{p}" for p in periods for c in ("n", "sum", "max"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queues = [TwoStackQueue() for _ in periods]
        out: list[tuple] = []
        entity, day = None, last + 1  # the entity at hand, and its next day without a row

        def emit(today: int, n: int) -> None:
            row = [entity, today, n]
            for q, p in zip(queues, periods):
                q.evict(today - p + 1)
                row.extend(q.total())
            out.append(tuple(row))

        def idle(until: int) -> Iterator[pd.DataFrame]:
            """Rows of days without activity, up to ``until``."""
            nonlocal day
            while day <= until:
                if not quiet and not any(q.front or q.back for q in queues):
                    day = until + 1
                    return
                emit(day, 0)
                if not quiet and not out[-1][-3]:
                    out.pop()
                day += 1
                if len(out) >= HELD:
                    yield flush()

        def flush() -> pd.DataFrame:
            nonlocal out
            f = pd.DataFrame(out, columns=names)
            out = []
            for p in periods:
                f[f"max_{p}"] = f[f"max_{p}"].astype("Int64")
            return f

        for b in batches:
            for e, d, n, total, top in zip(b["entity"].tolist(), b["day"].tolist(), b["n"].tolist(), b["total"].tolist(), b["top"].tolist()):
                if e != entity:
                    yield from idle(last)
                    entity, day = e, first
                    for q in queues:
                        q.clear()
                yield from idle(d - 1)
                value = (n, total, None if top is None or top != top else int(top))
                for q in queues:
                    q.push(d, value)
                emit(d, n)
                day = d + 1
        yield from idle(last)
        if out:
            yield flush()

    return run


def trailing_totals(
    mentions: DataFrame, periods: tuple[int, ...] = (7, 30), entity: str = "entity", ts: str = "ts", record: str | None = "msg_id", value: str | None = "engagement", quiet: bool = True
) -> DataFrame:
    """For each entity and each day between the table's first and last: trailing figures of ``periods`` days, that day the last.

    Columns: entity, day (date), n (that day's records), and for each period p: n_p, sum_p and
    max_p of ``value``, avg_p (n_p / p).  max_p is null where the period holds no value.

    A (``record``, entity) counts once, by its earliest ts and largest value; where ``record`` is
    null, or no record column is given, each row counts.  Rows with a null entity or ts are left
    out; null values add nothing; an empty table gives no rows; other columns are not read.
    With ``quiet`` off, days whose longest period is empty are left out.

    Rows are brought to one per entity and day before they are spread by entity, so an entity
    with a third of all rows is a few rows; a task walks its entities in order and holds one window.
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods are numbers of days, at least 1")
    v = F.col(value).cast("long") if value else F.lit(None).cast("long")
    rows = mentions.select(F.col(entity).alias("entity"), F.to_date(F.col(ts)).alias("day"), v.alias("v"), *([F.col(record).alias("r")] if record else []))
    rows = rows.where("entity is not null and day is not null")
    if record:
        once = rows.where("r is not null").groupBy("entity", "r").agg(F.min("day").alias("day"), F.max("v").alias("v")).select("entity", "day", "v")
        rows = once.unionByName(rows.where("r is null").select("entity", "day", "v"))
    daily = rows.groupBy("entity", F.unix_date("day").alias("day")).agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.max("v").alias("top"))
    ends = mentions.select(F.unix_date(F.to_date(F.col(ts))).alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()  # one row
    first, last = (1, 0) if ends["a"] is None else (ends["a"], ends["b"])
    periods = tuple(sorted(set(periods)))
    spread = daily.repartition(tasks(mentions.sparkSession), "entity").sortWithinPartitions("entity", "day")
    kinds = ", ".join(f"n_{p} long, sum_{p} long, max_{p} long" for p in periods)
    out = spread.mapInPandas(_windows(first, last, periods, quiet), f"entity string, day int, n long, {kinds}")
    figures = [c for p in periods for c in (F.col(f"n_{p}"), F.col(f"sum_{p}"), F.col(f"max_{p}"), (F.col(f"n_{p}") / p).alias(f"avg_{p}"))]
    return out.select("entity", F.date_from_unix_date("day").alias("day"), "n", *figures)


def quiet_after_burst(mentions: DataFrame) -> DataFrame:
    """(entity, day): days without a mention whose 7-day total is 3 or more and at least half the 30-day total."""
    t = trailing_totals(mentions, (7, 30), value=None, quiet=False)
    return t.where("n = 0 and n_7 >= 3 and 2 * n_7 >= n_30").select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"))


