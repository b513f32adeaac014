"""Queries p2 and p4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import late_events, rolling
from ..sources.tables import table
from .registry import register


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.quiet_after_burst(table(spark, sf_dir, "entity_mentions"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolling.trailing_totals(table(spark, sf_dir, "entity_mentions"), (7, 30))
    return t.select("entity", "day", "n", "n_7", "sum_7", "max_7", F.round("avg_7", 6).alias("avg_7"), "n_30", "sum_30", "max_30", F.round("avg_30", 6).alias("avg_30"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.late_corrections(table(spark, sf_dir, "normalized_messages"))


def p4_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = late_events.corrected_hours(table(spark, sf_dir, "normalized_messages"))
    return c.select("source", late_events.hour_text("period").alias("period_hour"), late_events.hour_text("arrival").alias("arrival_hour"), "added", "n", "total")


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each hour of arrival, each source's figures of the 24 hours up to it, as known then."""
    c = late_events.trailing_at_arrival(table(spark, sf_dir, "normalized_messages"))
    return c.select("source", late_events.hour_text("arrival").alias("arrival_hour"), "n", "total")


_DAILY = """
with m as (select entity, msg_id, min(ts::date) d, max(engagement) v from entity_mentions where entity is not null and ts is not null group by 1, 2),
g as (select unnest(generate_series((select min(ts)::date from entity_mentions), (select max(ts)::date from entity_mentions), interval 1 day))::date d),
e as (select distinct entity from m),
a as (select entity, d, count(*) n, sum(v) s, max(v) t from m group by 1, 2),
f as (select e.entity, g.d, coalesce(a.n, 0) n, coalesce(a.s, 0) s, a.t from e cross join g left join a on a.entity = e.entity and a.d = g.d),
w as (select entity, d, n, sum(n) over q n_7, sum(s) over q s_7, max(t) over q t_7, sum(n) over r n_30, sum(s) over r s_30, max(t) over r t_30 from f
  window q as (partition by entity order by d rows between 6 preceding and current row), r as (partition by entity order by d rows between 29 preceding and current row))
"""

_ARRIVALS = """
with f as (select raw_source, ts, created_at, engagement, row_number() over (partition by raw_source, raw_id order by created_at, ts, engagement) k
  from normalized_messages where ts is not null and created_at is not null),
h as (select raw_source, date_trunc('hour', ts) p, date_trunc('hour', created_at) a, count(*) added, sum(engagement) v from f
  where k = 1 and created_at < date_trunc('hour', ts) + interval 25 hour group by all)
"""

register("p2_found", p2_found, _DAILY + "select entity, strftime(d, '%Y-%m-%d') as day from w where n = 0 and n_7 >= 3 and 2 * n_7 >= n_30")
register(
    "p2_totals",
    p2_totals,
    _DAILY + "select entity, d as day, n, n_7::bigint n_7, s_7::bigint sum_7, t_7::bigint max_7, round(n_7 / 7.0, 6)::double avg_7, n_30::bigint n_30, s_30::bigint sum_30, t_30::bigint max_30, round(n_30 / 30.0, 6)::double avg_30 from w",
)
register("p4_found", p4_found, _ARRIVALS + "select raw_source, strftime(p, '%Y-%m-%dT%H') period_hour, strftime(a, '%Y-%m-%dT%H') arrival_hour from h where a > p")
register(
    "p4_hours",
    p4_hours,
    _ARRIVALS
    + """select raw_source source, strftime(p, '%Y-%m-%dT%H') period_hour, strftime(a, '%Y-%m-%dT%H') arrival_hour, added,
(sum(added) over w)::bigint n, (sum(v) over w)::bigint total from h window w as (partition by raw_source, p order by a)""",
)
register(
    "p4_trailing",
    p4_trailing,
    _ARRIVALS
    + """select d.raw_source source, strftime(d.a, '%Y-%m-%dT%H') arrival_hour, coalesce(sum(x.added), 0)::bigint n, coalesce(sum(x.v), 0)::bigint total
from (select distinct raw_source, a from h) d left join h x on x.raw_source = d.raw_source and x.a <= d.a and x.p > d.a - interval 24 hour and x.p <= d.a group by all""",
)
