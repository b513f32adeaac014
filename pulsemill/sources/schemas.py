"""Schemas of the tables, and their creation as Parquet tables of a database."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The tables' columns.
POST = "id bigint, content string, author string, posted_at timestamp_ntz, created_at timestamp_ntz, is_summarized boolean"
SCHEMAS = {
    "twitter_posts": POST + ", tweet_id string",
    "binance_square_posts": POST + ", post_id string",
    "discord_messages": "id bigint, channel_name string, username string, content string, post_id string, posted_at timestamp_ntz, created_at timestamp_ntz, is_summarized boolean",
    "normalized_messages": "id bigint, raw_source string, raw_id bigint, text string, author string, author_weight double, ts timestamp_ntz, engagement int, simhash bigint, sentiment_score double, is_duplicate boolean, dup_of bigint, l1_processed_at timestamp_ntz, created_at timestamp_ntz",
    "entity_mentions": "msg_id bigint, entity string, entity_type string, raw_source string, ts timestamp_ntz, engagement int, author_weight double, confidence double, is_kol_mention boolean",
    "hotness_snapshots": "window_end timestamp_ntz, window_type string, entity string, entity_type string, count_short bigint, count_baseline double, growth_rate double, cross_source bigint, engagement_sum bigint, is_new_entity boolean, final_score double, `rank` int",
    "entity_cooccurrence": "entity_a string, entity_b string, window_end timestamp_ntz, window_type string, cooccur_count bigint, pmi double, is_new_pair boolean, created_at timestamp_ntz",
    "entity_briefings": "entity string, window_end timestamp_ntz, narrative string, catalyst string, fund_logic string, sentiment string, confidence double, evidence_msg_ids array<bigint>, raw_response string, created_at timestamp_ntz",
}
# The unique key of each table that has one.
KEYS = {
    "normalized_messages": ["raw_source", "raw_id"],
    "entity_mentions": ["msg_id", "entity"],
    "hotness_snapshots": ["window_end", "window_type", "entity"],
    "entity_cooccurrence": ["entity_a", "entity_b", "window_end", "window_type"],
    "entity_briefings": ["entity", "window_end"],
}


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and every table that is not there yet."""
    spark.sql(f"create database if not exists `{database}`")
    for name, columns in SCHEMAS.items():
        spark.sql(f"create table if not exists `{database}`.`{name}` ({columns}) using parquet")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in SCHEMAS:
        spark.sql(f"drop table if exists `{database}`.`{name}`")
    spark.sql(f"drop database if exists `{database}`")
