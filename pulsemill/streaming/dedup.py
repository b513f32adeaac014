"""Near-duplicate check over a stream of fingerprints, its horizon held as keyed state that ends with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fingerprints import band_values

STATE = "prints array<struct<id: long, hash: long, bucket: long, own: boolean>>"
FOUND = "msg_id long, prior_id long, distance int"
HOUR_MS = 3_600_000


def _keep(radius: int, hours: int, wait_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(p) for p in state.get[0]] if state.exists else []
        rows = sorted(row for f in frames for row in zip(f["bucket"].tolist(), f["micros"].tolist(), f["id"].tolist(), f["simhash"].tolist(), f["own"].tolist()))
        found = []
        for bucket, _, i, h, own in rows:
            for j, other, b, theirs in held:
                if not own and not theirs:
                    continue  # both of the block before: they meet there
                d = ((h ^ other) & (2**64 - 1)).bit_count()
                if d > radius or i == j:
                    continue
                if own and bucket - hours <= b <= bucket:
                    found.append((i, j, d))
                elif theirs and b - hours <= bucket < b:  # a late one: what is held came after it
                    found.append((j, i, d))
            held.append((i, h, bucket, own))
        state.update(([{"id": i, "hash": h, "bucket": b, "own": o} for i, h, b, o in held],))
        end = (int(key[2]) + 1) * (hours + 1) * HOUR_MS + wait_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["msg_id", "prior_id", "distance"])

    return run


def near_duplicates(prints: DataFrame, radius: int = 3, hours: int = 24, lateness: str = "24 hours") -> DataFrame:
    """(msg_id, prior_id, distance) of a stream of (id, simhash, ts); a pair may come once for each band both share.

    Keyed by band, its value and block of ``hours + 1`` hours: two near prints agree on one band at
    least, and each print is sent to its own block and the next, so a pair within the horizon meets in
    the block of the later one.  A block's state goes once the watermark is past its end; rows later
    than ``lateness`` are left out.  Of two prints of one hour that arrive in different batches the one
    that came first is the prior.
    """
    rows = prints.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", lateness).where("id is not null and simhash is not null and t is not null")
    rows = rows.select("id", "simhash", "t", F.unix_micros("t").alias("micros"), F.floor(F.unix_seconds("t") / 3600).alias("bucket"), F.explode(band_values("simhash", radius)).alias("b"))
    block = F.floor(F.col("bucket") / (hours + 1))
    sent = rows.withColumn("x", F.explode(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
    keyed = sent.select("b.band", "b.value", "x.block", "x.own", "id", "simhash", "micros", "bucket", "t")
    return keyed.groupBy("band", "value", "block").applyInPandasWithState(_keep(radius, hours, HOUR_MS), FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)
