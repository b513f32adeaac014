"""Queries on entity pairs of a window, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence as c
from ..sources.tables import table
from .registry import register

END = datetime.datetime(2020, 4, 20, 18, 0)
BOARD = c.PairBoard("24h", top_pairs=100, min_count=2, min_pmi=0.5, min_msgs=50)
_START = END - datetime.timedelta(hours=24)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_mentions")


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pair_board(mentions(spark, sf_dir), END, BOARD)


_SQL = f"""
with w as (select distinct msg_id, entity from entity_mentions where ts >= timestamp '{_START}' and ts < timestamp '{END}' and msg_id is not null and entity is not null),
f as (select msg_id, entity from w qualify row_number() over (partition by msg_id order by entity) <= 10),
k as (select entity, count(*) n from f group by 1), t as (select count(distinct msg_id) n from w),
p as (select x.entity entity_a, y.entity entity_b, count(*) cooccur_count from f x join f y on x.msg_id = y.msg_id and x.entity < y.entity group by 1, 2),
b as (select p.*, u.n count_a, v.n count_b, t.n total, ln(cooccur_count / ((u.n * v.n) / t.n::double)) pmi from p join k u on u.entity = entity_a join k v on v.entity = entity_b, t
 where cooccur_count >= 2 and t.n >= 50 and ln(cooccur_count / ((u.n * v.n) / t.n::double)) >= 0.5 order by pmi desc, entity_a, entity_b limit 100)
"""
_LIST = "timestamp '2020-04-20 18:00:00' window_end, '24h' window_type, entity_a, entity_b, cooccur_count, count_a, count_b, total, round(pmi, 6) pmi"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("pmi", F.round("pmi", 6))


register("pmi_top", lambda spark, d: _rounded(board(spark, d)), _SQL + f"select {_LIST} from b")
_OLD = _SQL + f""", h as (select distinct msg_id, entity from entity_mentions where ts >= timestamp '{END - datetime.timedelta(days=7)}' and ts < timestamp '{_START}'),
q as (select distinct x.entity entity_a, y.entity entity_b from h x join h y on x.msg_id = y.msg_id and x.entity < y.entity)\n"""
register("new_pairs", lambda spark, d: _rounded(c.with_new(board(spark, d), mentions(spark, d), END, BOARD, 2)), _OLD + f"select {_LIST}, cooccur_count >= 2 and (entity_a, entity_b) not in (select (entity_a, entity_b) from q) is_new_pair from b")
register("top_pairs", lambda spark, d: _rounded(board(spark, d)).orderBy(F.desc("pmi"), "entity_a", "entity_b").limit(10).select("entity_a", "entity_b", "pmi"), _SQL + "select entity_a, entity_b, round(pmi, 6) pmi from b order by b.pmi desc, entity_a, entity_b limit 10")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(c.neighbors(board(spark, sf_dir), "RICAKI", 5))


register("neighbors", neighbors, _SQL + "select case when entity_a = 'RICAKI' then entity_b else entity_a end other, round(pmi, 6) pmi, cooccur_count from b where entity_a = 'RICAKI' or entity_b = 'RICAKI' order by b.pmi desc, other limit 5")
register("pmi_percentiles", lambda spark, d: board(spark, d).agg(*(F.round(F.percentile("pmi", p / 100), 6).alias(f"p{p}") for p in (25, 50, 75, 90)), F.count("*").alias("n")), _SQL + "select " + ", ".join(f"round(percentile_cont({p / 100}) within group (order by pmi), 6) p{p}" for p in (25, 50, 75, 90)) + ", count(*) n from b")
register(
    "pair_counts",
    lambda spark, d: c.pairs_of(c.capped(c.window_mentions(mentions(spark, d), _START, END), 10)),
    _SQL + "select entity_a, entity_b, cooccur_count n from p",
)
register("entity_msg_counts", lambda spark, d: c.window_mentions(mentions(spark, d), _START, END).groupBy("entity").agg(F.count("*").alias("n")), _SQL + "select entity, count(*) n from w group by 1")
register("distinct_msgs", lambda spark, d: c.window_mentions(mentions(spark, d), _START, END).agg(F.count_distinct("msg_id").alias("n")), _SQL + "select n from t")


def pair_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with two given entities, over the whole table."""
    m = mentions(spark, sf_dir)
    a, b = m.where("entity = 'RICAKI'").select("msg_id"), m.where("entity = 'KEPER'").select("msg_id")
    return a.join(b, "msg_id").agg(F.count_distinct("msg_id").alias("n"))


register("pair_self_join", pair_self_join, "select count(distinct a.msg_id) n from entity_mentions a join entity_mentions b on a.msg_id = b.msg_id where a.entity = 'RICAKI' and b.entity = 'KEPER'")


def candidate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of entities that were active in the window."""
    m = mentions(spark, sf_dir)
    active = c.window_mentions(m, _START, END).select("entity").distinct()
    return m.join(active, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


register("candidate_semi", candidate_semi, _SQL + "select entity, count(*) n from entity_mentions where entity in (select entity from w) group by 1")
