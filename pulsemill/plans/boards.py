"""Queries of the hotness family on ``entity_mentions``, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cooldown
from ..operators import hotness as h
from ..session import cut
from ..sources.tables import state_of, table
from .registry import register

AS_OF = datetime.datetime(2020, 4, 20, 18, 7)
END = h.quarter_of(AS_OF)
#: the moment that the point lookups ask for
MOMENT = datetime.datetime(2020, 4, 20)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_mentions")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _ts(moment: datetime.datetime) -> str:
    return f"timestamp '{moment:%Y-%m-%d %H:%M:%S}'"


def board_sql(b: h.Board, k: int | None = None, vocab: bool = True) -> str:
    """One board as SQL."""
    hours = int(b.hours)
    start, base = END - datetime.timedelta(hours=hours), END - datetime.timedelta(days=b.baseline_days)
    kind = "coalesce((select arg_min(v.entity_type, v.ord) from vocab v where v.name = r.entity), 'ticker')" if vocab else "'ticker'"
    return f"""
select {_ts(END)} window_end, '{b.window}' window_type, entity, {kind} entity_type, short_count count_short, round(count_baseline, 6) count_baseline,
 round(growth_rate, 6) growth_rate, cross_source, engagement_sum, is_new_entity, round(final_score, 6) final_score, rank::int rank from (
 select *, row_number() over (order by final_score desc, short_count desc, entity) rank from (
  select *, growth_rate * (1 + 0.3::double * (cross_source - 1)) final_score, baseline_total = 0 and short_count >= 5 is_new_entity from (
   select *, short_count / greatest(count_baseline, {b.smoothing}::double) growth_rate from (
    select *, baseline_total / {b.baseline_days * 24 - hours}::double count_baseline from (
     select entity, count(*) filter (where ts >= {_ts(AS_OF)} - interval {hours} hour) short_count,
      count(*) filter (where ts >= {_ts(base)} and ts < {_ts(start)}) baseline_total,
      count(distinct raw_source) filter (where ts >= {_ts(start)} and ts < {_ts(END)}) cross_source,
      coalesce(sum(engagement) filter (where ts >= {_ts(start)} and ts < {_ts(END)}), 0)::bigint engagement_sum
     from entity_mentions where ts <= {_ts(AS_OF)} and entity is not null group by entity) where short_count > 0)))) r
where rank <= {k or b.top_k} and (select count(*) from entity_mentions where ts <= {_ts(AS_OF)} and entity is not null and ts >= {_ts(AS_OF)} - interval {b.baseline_days} day) >= {b.min_baseline}"""


def _board(b: h.Board):
    return lambda spark, d: _rounded(h.hotness_board(mentions(spark, d), table(spark, d, "vocab"), AS_OF, b))


for _w, _b in h.BOARDS.items():
    register(f"hotness_{_w}", _board(_b), board_sql(_b))


def hotness_all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(h.hotness_boards(mentions(spark, sf_dir), table(spark, sf_dir, "vocab"), AS_OF, tuple(h.BOARDS.values())))


register("hotness_all_windows", hotness_all_windows, "\nunion all\n".join(f"(select * from ({board_sql(b)}))" for b in h.BOARDS.values()))

_OPEN = h.Board("24h", smoothing=10.0, baseline_days=8, min_baseline=0)
register("hotness_24h_open", _board(_OPEN), board_sql(_OPEN))
_OLD = h.Board("24h", smoothing=10.0, baseline_days=8, min_baseline=10**9)
register("baseline_gate_closed", _board(_OLD), board_sql(_OLD))

_NAMES = ("ricaki", "KEPER")
_EXCLUDED = h.Board("24h", smoothing=10.0, baseline_days=8, min_baseline=0, exclude=_NAMES)
register(
    "blacklist_topk",
    _board(_EXCLUDED),
    board_sql(h.Board("24h", smoothing=10.0, baseline_days=8, min_baseline=0)).replace("where short_count > 0", "where short_count > 0 and upper(entity) not in ('RICAKI', 'KEPER')"),
)

register(
    "sliding_counts",
    lambda spark, d: h.sliding_counts(mentions(spark, d), AS_OF),
    "select entity, " + ", ".join(f"count(*) filter (where ts >= {_ts(AS_OF)} - interval {int(v * 60)} minute) \"n_{w}\"" for w, v in h.WINDOWS.items())
    + f" from entity_mentions where entity is not null and ts <= {_ts(AS_OF)} and ts >= {_ts(AS_OF)} - interval 168 hour group by entity",
)
for _w in ("24h", "7d"):
    register(
        f"active_entities_{_w}",
        lambda spark, d, w=_w: h.active_entities(mentions(spark, d), AS_OF, w),
        f"select entity, max(ts) last_ts from entity_mentions where entity is not null and ts <= {_ts(AS_OF)} and ts >= {_ts(AS_OF)} - interval {int(h.WINDOWS[_w])} hour group by entity",
    )
register(
    "baseline_gate",
    lambda spark, d: h.enough(mentions(spark, d), AS_OF, 7, 100),
    f"select count(*) >= 100 ok, count(*) n from entity_mentions where entity is not null and ts <= {_ts(AS_OF)} and ts >= {_ts(AS_OF)} - interval 7 day",
)


def realtime_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth figures at the moment itself, on no quarter and with no top k."""
    b = h.Board("1h", smoothing=2.0, baseline_days=7)
    m = h.scored(h.measures(mentions(spark, sf_dir), AS_OF, b, aligned=False), b)
    return _rounded(m.where("short_count >= 1").select("entity", "short_count", "baseline_total", "count_baseline", "growth_rate", "cross_source"))


register(
    "realtime_candidates",
    realtime_candidates,
    f"""select entity, short_count, baseline_total, round(baseline_total / 167::double, 6) count_baseline, round(short_count / greatest(baseline_total / 167::double, 2::double), 6) growth_rate, cross_source from (
 select entity, count(*) filter (where ts >= {_ts(AS_OF)} - interval 1 hour) short_count,
 count(*) filter (where ts >= {_ts(AS_OF)} - interval 7 day and ts < {_ts(AS_OF)} - interval 1 hour) baseline_total,
 count(distinct raw_source) filter (where ts >= {_ts(AS_OF)} - interval 1 hour and ts < {_ts(AS_OF)}) cross_source
 from entity_mentions where ts <= {_ts(AS_OF)} and entity is not null group by entity) where short_count >= 1""",
)
register(
    "align_quarter",
    lambda spark, d: mentions(spark, d).groupBy(h.align_to_quarter(F.col("ts")).alias("quarter_start")).agg(F.count("*").alias("n")),
    "select date_trunc('hour', ts) + interval 15 minute * (minute(ts) // 15)::int as quarter_start, count(*) n from entity_mentions group by 1",
)
register(
    "cross_source",
    lambda spark, d: mentions(spark, d).where(F.col("ts") >= h.at(AS_OF - datetime.timedelta(days=1))).where(F.col("ts") < h.at(AS_OF)).groupBy("entity").agg(F.count_distinct("raw_source").alias("sources"), F.count("*").alias("n")),
    f"select entity, count(distinct raw_source) sources, count(*) n from entity_mentions where ts >= {_ts(AS_OF)} - interval 1 day and ts < {_ts(AS_OF)} group by entity",
)


# ---- snapshot history, and what is read from it ----


_QUARTER = datetime.timedelta(minutes=15)
_held: dict[tuple, DataFrame] = {}


def span(rows: DataFrame) -> tuple[datetime.datetime, datetime.datetime]:
    """The ends of the quarters that the table's first and last mention are in."""
    first, last = rows.where("entity is not null").agg(F.min("ts"), F.max("ts")).first()
    return (h.quarter_of(first) + _QUARTER, h.quarter_of(last) + _QUARTER) if first else (MOMENT, MOMENT)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boards at every quarter of the table's time, written once for the table as it is and then read."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/entity_mentions.parquet"))
    if key not in _held:
        rows = mentions(spark, sf_dir)
        _held[key] = cut(h.snapshot_history(rows, *span(rows), tuple(h.BOARDS.values()), 0.25), "history")
    return _held[key]


def _history_part(b: h.Board) -> str:
    """One board at every quarter: mentions handed to each quarter whose window they are in, the baseline as running counts looked up at the window's two ends."""
    w, k = int(b.hours), int(b.hours * 4)
    return f"""
select we window_end, '{b.window}' window_type, entity, short_count count_short, count_baseline, growth_rate, cross_source, engagement_sum, is_new_entity, final_score,
 row_number() over (partition by we order by final_score desc, short_count desc, entity)::int rank from (
 select *, growth_rate * (1 + 0.3::double * (cross_source - 1)) final_score, baseline_total = 0 and short_count >= 5 is_new_entity from (
  select *, short_count / greatest(count_baseline, {b.smoothing}::double) growth_rate from (
   select *, baseline_total / {b.baseline_days * 24 - w}::double count_baseline from (
    select s.*, coalesce(x.c, 0) - coalesce(y.c, 0) baseline_total from (
     select entity, q + interval 15 minute * i we, count(*) short_count, count(distinct raw_source) cross_source, coalesce(sum(engagement), 0)::bigint engagement_sum
     from m, range(1, {k + 1}) r(i) where q + interval 15 minute * i <= (select max(q) + interval 15 minute from m) group by 1, 2) s
    asof left join c x on x.entity = s.entity and x.q < s.we - interval {w} hour
    asof left join c y on y.entity = s.entity and y.q < s.we - interval {b.baseline_days} day))))
qualify rank <= {b.top_k}"""


HISTORY = (
    "with m as (select entity, raw_source, engagement, time_bucket(interval 15 minute, ts) q from entity_mentions where entity is not null and ts is not null),\n"
    "c as (select entity, q, sum(count(*)) over (partition by entity order by q) c from m group by 1, 2), hist as ("
    + " union all ".join(f"(select * from ({_history_part(b)}))" for b in h.BOARDS.values())
    + ")\n"
)

register("snapshot_history", lambda spark, d: _rounded(history(spark, d)), HISTORY + "select window_end, window_type, entity, count_short, round(count_baseline, 6) count_baseline, round(growth_rate, 6) growth_rate, cross_source, engagement_sum, is_new_entity, round(final_score, 6) final_score, rank from hist")
register("latest_window", lambda spark, d: history(spark, d).groupBy("window_type").agg(F.max("window_end").alias("window_end")), HISTORY + "select window_type, max(window_end) window_end from hist group by 1")


def board_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir).where("window_type = '24h'")
    last = hist.agg(F.max("window_end").alias("m"))
    return _rounded(hist.where(F.col("window_end") == last.scalar()).orderBy("rank").limit(10).select("entity", "rank", "growth_rate", "final_score"))


register("board_topk", board_topk, HISTORY + "select entity, rank, round(growth_rate, 6) growth_rate, round(final_score, 6) final_score from hist where window_type = '24h' and window_end = (select max(window_end) from hist where window_type = '24h') and rank <= 10")


def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir)
    last = hist.groupBy("window_type").agg(F.max("window_end").alias("window_end"))
    return _rounded(hist.join(last, ["window_type", "window_end"], "left_semi").where("rank <= 5").select("window_type", "entity", "rank", "growth_rate"))


register("latest_per_type_semi", latest_per_type, HISTORY + "select window_type, entity, rank, round(growth_rate, 6) growth_rate from hist where (window_type, window_end) in (select (window_type, max(window_end)) from hist group by window_type) and rank <= 5")


def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir)
    g = hist.groupBy("window_end", "entity").agg(F.sort_array(F.collect_set("window_type")).alias("windows"), F.round(F.max("growth_rate"), 6).alias("peak"))
    return g.where(F.size("windows") == len(h.BOARDS))


register("resonance", resonance, HISTORY + "select window_end, entity, list_sort(list(distinct window_type)) windows, round(max(growth_rate), 6) peak from hist group by 1, 2 having count(distinct window_type) = 4")
register(
    "growth_percentiles",
    lambda spark, d: history(spark, d).groupBy("window_type").agg(*(F.round(F.percentile("growth_rate", p / 100), 6).alias(f"p{p}") for p in (50, 75, 90, 95, 97, 99)), F.round(F.max("growth_rate"), 6).alias("top"), F.count("*").alias("n")),
    HISTORY + "select window_type, " + ", ".join(f"round(percentile_cont({p / 100}) within group (order by growth_rate), 6) p{p}" for p in (50, 75, 90, 95, 97, 99)) + ", round(max(growth_rate), 6) top, count(*) n from hist group by 1",
)
_LEVELS = (0.5, 1.0, 2.0, 3.0)
register(
    "threshold_backtest",
    lambda spark, d: history(spark, d).groupBy("window_type").agg(*(F.count_if(F.col("growth_rate") >= x).alias(f"hits_{int(x * 10)}") for x in _LEVELS), F.count("*").alias("n")),
    HISTORY + "select window_type, " + ", ".join(f"count(*) filter (where growth_rate >= {x}) hits_{int(x * 10)}" for x in _LEVELS) + ", count(*) n from hist group by 1",
)
register(
    "snapshot_funnel",
    lambda spark, d: history(spark, d).groupBy("window_type").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("window_end").alias("windows")),
    HISTORY + "select window_type, count(*) n, count(distinct entity) entities, count(distinct window_end) windows from hist group by 1",
)
register(
    "daily_hits",
    lambda spark, d: history(spark, d).where("growth_rate >= 0.5").groupBy(F.to_date("window_end").alias("day"), "window_type").agg(F.count("*").alias("hits")),
    HISTORY + "select window_end::date as day, window_type, count(*) hits from hist where growth_rate >= 0.5 group by 1, 2",
)
def _mean(c: str):
    """Average over decimals, which no order of the rows can change."""
    return F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count("*")


register(
    "persistence",
    lambda spark, d: _rounded(
        history(spark, d).where(F.col("window_end") > h.at(span(mentions(spark, d))[1] - datetime.timedelta(days=1))).groupBy("entity").agg(F.count("*").alias("boards"), F.avg("rank").alias("avg_rank"), F.min("rank").alias("best_rank"), _mean("growth_rate").alias("avg_growth"), _mean("final_score").alias("avg_score"), F.bool_or("is_new_entity").alias("ever_new"))
        .orderBy(F.desc("boards"), F.asc("avg_rank"), "entity").limit(25)
    ),
    HISTORY + f"""select entity, count(*) boards, round(avg(rank), 6) avg_rank, min(rank) best_rank, round(sum(growth_rate::decimal(28, 10))::double / count(*), 6) avg_growth, round(sum(final_score::decimal(28, 10))::double / count(*), 6) avg_score, bool_or(is_new_entity) ever_new
from hist where window_end > (select max(q) + interval 15 minute from m) - interval 1 day group by entity order by count(*) desc, avg(rank), entity limit 25""",
)
register(
    "recent_bursts",
    lambda spark, d: _rounded(history(spark, d).orderBy(F.desc_nulls_first("growth_rate"), F.desc("window_end"), "window_type", "entity").limit(15).select("window_end", "window_type", "entity", "growth_rate", "count_short")),
    HISTORY + "select window_end, window_type, entity, round(growth_rate, 6) growth_rate, count_short from hist order by hist.growth_rate desc nulls first, window_end desc, window_type, entity limit 15",
)
register(
    "hit_type",
    lambda spark, d: history(spark, d).groupBy(F.when(F.col("is_new_entity"), "new").when(F.col("cross_source") >= 2, "cross").otherwise("single").alias("hit"), "window_type").agg(F.count("*").alias("n")),
    HISTORY + "select case when is_new_entity then 'new' when cross_source >= 2 then 'cross' else 'single' end hit, window_type, count(*) n from hist group by 1, 2",
)


# ---- lookups in the history ----

_SINCE = MOMENT - datetime.timedelta(days=2)
register(
    "lookup_point",
    lambda spark, d: _rounded(history(spark, d).where((F.col("entity") == "RICAKI") & (F.col("window_end") == h.at(MOMENT))).select("window_type", "rank", "growth_rate")),
    HISTORY + f"select window_type, rank, round(growth_rate, 6) growth_rate from hist where entity = 'RICAKI' and window_end = {_ts(MOMENT)}",
)
register(
    "lookup_latest",
    lambda spark, d: history(spark, d).where((F.col("window_type") == "24h") & (F.col("window_end") >= h.at(_SINCE))).groupBy("entity").agg(F.max("window_end").alias("window_end"), F.max_by("rank", "window_end").alias("rank")),
    HISTORY + f"select entity, max(window_end) window_end, arg_max(rank, window_end) as rank from hist where window_type = '24h' and window_end >= {_ts(_SINCE)} group by 1",
)
register(
    "lookup_recent",
    lambda spark, d: history(spark, d).where("window_type = '6h'").orderBy(F.desc("window_end"), "rank").limit(30).select("window_end", "entity", "rank"),
    HISTORY + "select window_end, entity, rank from hist where window_type = '6h' order by window_end desc, rank limit 30",
)
register(
    "type_of_hits",
    lambda spark, d: history(spark, d).join(table(spark, d, "vocab").groupBy(F.col("name").alias("entity")).agg(F.min_by("entity_type", "ord").alias("entity_type")), "entity", "left").groupBy(F.coalesce("entity_type", F.lit("other")).alias("entity_type"), F.when(F.col("is_new_entity"), "new").otherwise("known").alias("hit")).agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities")),
    HISTORY + "select coalesce((select arg_min(v.entity_type, v.ord) from vocab v where v.name = hist.entity), 'other') entity_type, case when is_new_entity then 'new' else 'known' end hit, count(*) n, count(distinct entity) entities from hist group by 1, 2",
)

_COOL = cooldown.Cooldown(quiet=datetime.timedelta(hours=8), heartbeat=datetime.timedelta(hours=24), escalation=1.5, step=0.2)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where("window_type = '24h'").select(F.col("entity").alias("key"), F.col("window_end").alias("at"), F.round("growth_rate", 6).alias("growth"), F.col("cross_source").alias("cross"))


def cooldown_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal against the key's one before it, whether that passed or not."""
    w = Window.partitionBy("key").orderBy("at")
    s = signals(spark, sf_dir).select("*", *(F.lag(c).over(w).alias(f"last_{c}") for c in ("at", "growth", "cross")))
    return s.select("key", "at", cooldown.decided(F.col("last_at"), F.col("last_growth"), F.col("last_cross"), F.col("at"), F.col("growth"), F.col("cross"), _COOL).alias("why"))


register(
    "cooldown_pairwise",
    cooldown_pairwise,
    HISTORY + """, s as (select entity as "key", window_end as "at", round(growth_rate, 6) growth, cross_source c, lag(window_end) over w l, lag(round(growth_rate, 6)) over w g, lag(cross_source) over w k from hist where window_type = '24h' window w as (partition by entity order by window_end))
select "key", "at", case when l is null then 'first' when "at" - l >= interval 24 hour then 'heartbeat' when g > 0 and growth >= g * 1.5::double then 'escalated' when c > k then 'wider' when g > 0 and growth >= g * 1.2::double then 'grown' when "at" - l >= interval 8 hour then 'again' end why from s""",
)
_WHY = """case when t.l is null then 'first' when s."at" - t.l >= interval 24 hour then 'heartbeat' when t.g > 0 and s.growth >= t.g * 1.5::double then 'escalated' when s."cross" > t.k then 'wider'
 when t.g > 0 and s.growth >= t.g * 1.2::double then 'grown' when s."at" - t.l >= interval 8 hour then 'again' end"""
register(
    "cooldown_fold",
    lambda spark, d: cooldown.passed(signals(spark, d), _COOL),
    HISTORY.replace("with ", "with recursive ", 1)
    + f""", s as (select entity as "key", window_end as "at", round(growth_rate, 6) growth, cross_source as "cross", row_number() over (partition by entity order by window_end) i from hist where window_type = '24h'),
t as (select "key", i, "at", growth, "cross", 'first' why, "at" l, growth g, "cross" k from s where i = 1
 union all select s."key", s.i, s."at", s.growth, s."cross", {_WHY} why, case when {_WHY} is null then t.l else s."at" end, case when {_WHY} is null then t.g else s.growth end, case when {_WHY} is null then t.k else s."cross" end
 from t join s on s."key" = t."key" and s.i = t.i + 1)
select "key", "at", growth, "cross", why from t where why is not null""",
)
