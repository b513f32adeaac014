"""64-bit similarity fingerprints and the duplicate check within a time horizon."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_KEPT = re.compile(r"[\w一-鿌]+")
_BITS = np.arange(64, dtype=np.uint64)
WIDTH = 4


def simhash_of(text: str | None) -> int | None:
    """Signed 64-bit fingerprint: of the text's four-letter features, by multiplicity, each bit's majority over their hashes."""
    if text is None:
        return None
    s = "".join(_KEPT.findall(text.lower()))
    features: dict[str, int] = {}
    for i in range(max(1, len(s) - WIDTH + 1)):
        f = s[i : i + WIDTH]
        features[f] = features.get(f, 0) + 1
    hashes = np.frombuffer(b"".join(hashlib.md5(f.encode("utf-8", "surrogatepass")).digest()[8:] for f in features), ">u8").astype(np.uint64)
    weights = np.fromiter(features.values(), np.int64, len(features))
    ones = (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * weights[:, None]).sum(axis=0)
    value = int(((ones * 2 > weights.sum()).astype(np.uint64) << _BITS).sum(dtype=np.uint64))
    return value - 2**64 if value >= 2**63 else value


@F.pandas_udf(LongType())
def simhash64(text: pd.Series) -> pd.Series:
    known = {t: simhash_of(t) for t in text.unique()}
    return text.map(known).astype("Int64")


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def hour_bucket(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)


def _rows(prints: DataFrame, hours: int) -> DataFrame:
    """(id, simhash, ts, bucket, block): prints with their hour and block of hours."""
    rows = prints.where("id is not null and simhash is not null and ts is not null").select("id", "simhash", "ts", hour_bucket("ts").alias("bucket"))
    return rows.withColumn("block", F.floor(F.col("bucket") / (hours + 1)))


def band_values(simhash: str, radius: int) -> Column:
    """An array of (band, value): ``radius + 1`` parts of a fingerprint, of which two within the radius have one in common."""
    bands = radius + 1
    width = 64 // bands
    part = lambda k: F.shiftrightunsigned(simhash, k * width).bitwiseAND(F.lit((1 << (width if k < bands - 1 else 64 - k * width)) - 1))
    return F.array(*(F.struct(F.lit(k).alias("band"), part(k).alias("value")) for k in range(bands)))


def near_prints(rows: DataFrame, radius: int) -> DataFrame:
    """(simhash, block, prior_hash, prior_block): fingerprints within the radius in a block and in it or the one before; a fingerprint is one row of a block, however many prints have it."""
    kinds = rows.select("simhash", "block").distinct().select("*", F.explode(band_values("simhash", radius)).alias("b")).select("simhash", "block", "b.band", "b.value")
    own = kinds.select("*", F.explode(F.array("block", F.col("block") - 1)).alias("prior_block"))
    prior = kinds.select(F.col("simhash").alias("prior_hash"), F.col("block").alias("prior_block"), "band", "value")
    return own.join(prior, ["band", "value", "prior_block"]).where(hamming("simhash", "prior_hash") <= radius).select("simhash", "block", "prior_hash", "prior_block").distinct()


def near_duplicates(prints: DataFrame, radius: int = 3, hours: int = 24) -> DataFrame:
    """(msg_id, prior_id, prior_bucket, distance): for each print those before it, in its horizon and within the radius.

    ``prints`` has (id, simhash, ts) and is taken in the order of ts, then id.  Fingerprints within
    ``radius`` bits agree on one of ``radius + 1`` bands at least, so an equi-join on (band, its
    value, block of hours) finds all of them; each is sent to the two blocks its horizon meets.
    Equal fingerprints of a block are one row on both sides until the pairs are made, and each pair is
    made once; a group of equal fingerprints still gives all its pairs, which are the result.
    """
    rows = _rows(prints, hours)
    prior = rows.select(F.col("id").alias("prior_id"), F.col("simhash").alias("prior_hash"), F.col("ts").alias("prior_ts"), F.col("bucket").alias("prior_bucket"), F.col("block").alias("prior_block"))
    pairs = rows.join(near_prints(rows, radius), ["simhash", "block"]).join(prior, ["prior_hash", "prior_block"]).where(
        ((F.col("prior_ts") < F.col("ts")) | ((F.col("prior_ts") == F.col("ts")) & (F.col("prior_id") < F.col("id"))))
        & (F.col("prior_bucket") >= F.col("bucket") - hours)
        & (F.col("prior_bucket") <= F.col("bucket"))
    )
    return pairs.select(F.col("id").alias("msg_id"), "prior_id", "prior_ts", "prior_bucket", hamming("simhash", "prior_hash").cast("int").alias("distance")).distinct()


def duplicate_of(prints: DataFrame, radius: int = 3, hours: int = 24) -> DataFrame:
    """(msg_id, dup_of): the first near duplicate in the oldest hour of the horizon that has one.

    That is the first print by (ts, id) of the horizon's near ones, if it is before the message, so
    the first of each fingerprint and hour is enough and no pairs of messages are made.
    """
    rows = _rows(prints, hours)
    hourly = rows.groupBy("simhash", "block", "bucket").agg(F.min(F.struct("ts", "id")).alias("first"))
    prior = hourly.select(F.col("simhash").alias("prior_hash"), F.col("block").alias("prior_block"), F.col("bucket").alias("prior_bucket"), F.col("first").alias("prior"))
    met = hourly.drop("first").join(near_prints(rows, radius), ["simhash", "block"]).join(prior, ["prior_hash", "prior_block"])
    met = met.where((F.col("prior_bucket") >= F.col("bucket") - hours) & (F.col("prior_bucket") <= F.col("bucket")))
    best = met.groupBy("simhash", "bucket").agg(F.min("prior").alias("m"))
    found = rows.join(best, ["simhash", "bucket"]).where((F.col("m.ts") < F.col("ts")) | ((F.col("m.ts") == F.col("ts")) & (F.col("m.id") < F.col("id"))))
    return found.groupBy(F.col("id").alias("msg_id")).agg(F.min("m").alias("m")).select("msg_id", F.col("m.id").alias("dup_of"))
