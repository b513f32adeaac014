"""The resident worker as a streaming query: each micro-batch goes through named stages in order."""

from __future__ import annotations

import datetime
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.hotness import quarter_of
from ..session import read_text, write_text

log = logging.getLogger("pulsemill.worker")

Stage = Callable[[DataFrame, int], object]


@dataclass
class Worker:
    """Runs the stages over every micro-batch; a stage that fails is logged and does not stop those after it."""

    stages: dict[str, Stage]
    failures: dict[str, int] = field(default_factory=dict)
    batches: int = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, stage in self.stages.items():
                try:
                    stage(batch, number)
                except Exception:
                    self.failures[name] = self.failures.get(name, 0) + 1
                    log.exception("stage %s failed on batch %d", name, number)
            self.batches += 1
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, poll: str | None = "30 seconds") -> StreamingQuery:
        """Start over ``stream``; with no ``poll`` interval what is there is taken and the query ends."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


@dataclass
class QuarterGate:
    """Runs an action once for each quarter of an hour, also over restarts: the last quarter done is kept in a file.

    A quarter whose action fails or returns false stays open, unless ``always``.
    """

    spark: SparkSession
    path: str
    action: Callable[[datetime.datetime], bool]
    always: bool = False

    def last(self) -> datetime.datetime | None:
        text = read_text(self.spark, self.path)
        return datetime.datetime.fromisoformat(text) if text else None

    def __call__(self, now: datetime.datetime) -> bool:
        end, last = quarter_of(now), self.last()
        if last is not None and end <= last:
            return False
        done = False
        try:
            done = bool(self.action(end))
        finally:
            if done or self.always:
                write_text(self.spark, self.path, end.isoformat())
        return done


@dataclass
class Burst:
    """Fires when enough rows came in since it last did, and not too soon after; rows stay counted until a firing succeeds."""

    action: Callable[[DataFrame, int], bool]
    least: int = 50
    gap_seconds: float = 30.0
    clock: Callable[[], float] = time.monotonic
    pending: int = 0
    last: float | None = None

    def __call__(self, batch: DataFrame, number: int) -> bool:
        self.pending += batch.count()
        now = self.clock()
        if self.pending < self.least or self.last is not None and now - self.last < self.gap_seconds:
            return False
        self.last = now
        if self.action(batch, number):
            self.pending = 0
            return True
        return False
