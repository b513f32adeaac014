"""From raw posts of several sources to normalized messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that is cut from both ends of a text, as a regular-expression class.
BLANKS = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

# The sources, in the order in which they are taken.
SOURCES = ("twitter", "binance_square", "discord")


def clean_text(text: str | Column) -> Column:
    """The text without white space at either end."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def posts_of(raw: DataFrame, source: str) -> DataFrame:
    """(raw_source, raw_id, content, author, ts, created_at) of one source's raw posts; a post's time is its own, else its arrival."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    author = F.concat(F.lit("#"), F.col("channel_name"), F.lit(" @"), F.col("username")) if source == "discord" else F.col("author")
    return raw.select(F.lit(source).alias("raw_source"), F.col("id").alias("raw_id"), "content", author.alias("author"), F.coalesce("posted_at", "created_at").alias("ts"), "created_at")


def unseen(posts: DataFrame, normalized: DataFrame, batch: int | None = None) -> DataFrame:
    """Posts that no normalized message came from; the first ``batch`` of them by arrival where a batch is asked for."""
    left = posts.join(normalized.select("raw_source", "raw_id").distinct(), ["raw_source", "raw_id"], "left_anti")
    return left if batch is None else left.orderBy("created_at", "raw_id").limit(batch)


def all_posts(twitter: DataFrame, binance: DataFrame, discord: DataFrame) -> DataFrame:
    out = posts_of(twitter, "twitter")
    for raw, source in ((binance, "binance_square"), (discord, "discord")):
        out = out.unionByName(posts_of(raw, source))
    return out


def normalized_rows(posts: DataFrame, *more: str) -> DataFrame:
    """Normalized messages of posts: cleaned text, constants of a new row, and the columns asked for; blank posts give none."""
    rows = posts.withColumn("text", clean_text("content")).where("text <> ''")
    return rows.select("raw_source", "raw_id", "text", "author", F.lit(1.0).alias("author_weight"), "ts", F.lit(0).alias("engagement"), *more)


def unprocessed(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages still to be looked at: no duplicates, not processed."""
    rows = messages.where("not is_duplicate and l1_processed_at is null")
    return rows if limit is None else rows.orderBy("ts", "id").limit(limit)
