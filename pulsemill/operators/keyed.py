"""Writes by key, as functions of the table before and the new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def insert_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and the new rows whose key is not in it; of new rows with one key the least one. Rows with a null key always go in."""
    rest = [c for c in new.columns if c not in key]
    whole = None
    for k in key:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    keyed = new.where(whole)
    if rest:
        keyed = keyed.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    else:
        keyed = keyed.distinct()
    fresh = keyed.join(table.select(*key), key, "left_anti").select(*table.columns)
    return table.unionByName(fresh).unionByName(new.where(~whole).select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the new rows in place of those of their key; keys that do not come again stay as they were."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*table.columns))


def replace_window(table: DataFrame, new: DataFrame, window: list[str]) -> DataFrame:
    """``table`` with all rows of the new rows' windows replaced."""
    return table.join(new.select(*window).distinct(), window, "left_anti").unionByName(new.select(*table.columns))


def mark_processed(messages: DataFrame, ids: DataFrame, moment) -> DataFrame:
    """``messages`` with l1_processed_at set for those ids where it was null."""
    found = messages.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), F.col("id") == F.col("_id"), "left")
    now = F.when(F.col("_hit") & F.col("l1_processed_at").isNull(), moment).otherwise(F.col("l1_processed_at"))
    return found.withColumn("l1_processed_at", now).select(*messages.columns)
