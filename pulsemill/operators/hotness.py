"""Hotness of entities over sliding windows: counts, baseline, growth, score, rank."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks

# The sliding windows, in hours.
WINDOWS = {"15min": 0.25, "1h": 1.0, "3h": 3.0, "6h": 6.0, "24h": 24.0, "7d": 168.0}


@dataclass(frozen=True)
class Board:
    """Parameters of one board; invalid combinations are refused."""

    window: str = "1h"
    top_k: int = 20
    smoothing: float = 2.0
    baseline_days: int = 7
    min_baseline: int = 100
    exclude: tuple[str, ...] = field(default=())
    cross_weight: float = 0.3
    new_entity_count: int = 5

    def __post_init__(self) -> None:
        if self.window not in WINDOWS:
            raise ValueError(f"unknown window {self.window!r}")
        if self.top_k < 1 or self.smoothing <= 0:
            raise ValueError("top_k and smoothing must be positive")
        if self.baseline_days * 24 <= WINDOWS[self.window]:
            raise ValueError("the baseline must be longer than the window")

    @property
    def hours(self) -> float:
        return WINDOWS[self.window]


# The four boards by default.
BOARDS = {
    "1h": Board("1h", smoothing=2.0, baseline_days=7, min_baseline=100),
    "3h": Board("3h", smoothing=3.0, baseline_days=7, min_baseline=150),
    "6h": Board("6h", smoothing=5.0, baseline_days=7, min_baseline=200),
    "24h": Board("24h", smoothing=10.0, baseline_days=8, min_baseline=500),
}


def align_to_quarter(ts: Column) -> Column:
    """The quarter of an hour a timestamp is in, as its first moment."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / 900) * 900).cast("timestamp_ntz")


def quarter_of(as_of: datetime.datetime) -> datetime.datetime:
    return as_of.replace(minute=as_of.minute - as_of.minute % 15, second=0, microsecond=0)


def at(moment: datetime.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _back(moment: datetime.datetime, hours: float) -> Column:
    return at(moment - datetime.timedelta(hours=hours))


def known(mentions: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Rows that had happened at ``as_of``: what a service running then could have seen."""
    return mentions.where((F.col("ts") <= at(as_of)) & F.col("entity").isNotNull())


def sliding_counts(mentions: DataFrame, as_of: datetime.datetime, windows: tuple[str, ...] = tuple(WINDOWS)) -> DataFrame:
    """(entity, n_<window>...): mentions in each trailing window, all windows in one pass; entities of the longest only."""
    longest = max(WINDOWS[w] for w in windows)
    rows = known(mentions, as_of).where(F.col("ts") >= _back(as_of, longest))
    return rows.groupBy("entity").agg(*(F.count_if(F.col("ts") >= _back(as_of, WINDOWS[w])).alias(f"n_{w}") for w in windows))


def active_entities(mentions: DataFrame, as_of: datetime.datetime, window: str) -> DataFrame:
    """(entity, last_ts): entities whose newest mention lies in the window."""
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    rows = known(mentions, as_of).where(F.col("ts") >= _back(as_of, WINDOWS[window]))
    return rows.groupBy("entity").agg(F.max("ts").alias("last_ts"))


def growth(short: Column, baseline: Column, smoothing: float) -> Column:
    return short / F.greatest(baseline, F.lit(float(smoothing)))


def score(growth_rate: Column, cross: Column, weight: float) -> Column:
    return growth_rate * (1 + weight * (cross - 1))


def measures(mentions: DataFrame, as_of: datetime.datetime, board: Board, aligned: bool = True) -> DataFrame:
    """Per entity with a mention in the window: short_count, baseline_total, cross_source, engagement_sum.

    The short count reaches back from ``as_of``; baseline and sources from the quarter it is in
    (from ``as_of`` itself when not ``aligned``).  The window lies outside its own baseline.
    """
    end = quarter_of(as_of) if aligned else as_of
    start, base = end - datetime.timedelta(hours=board.hours), end - datetime.timedelta(days=board.baseline_days)
    ts = F.col("ts")
    inside = (ts >= at(start)) & (ts < at(end))
    rows = known(mentions, as_of).where(ts >= F.least(at(base), _back(as_of, board.hours)))
    return (
        rows.groupBy("entity")
        .agg(
            F.count_if(ts >= _back(as_of, board.hours)).alias("short_count"),
            F.count_if((ts >= at(base)) & (ts < at(start))).alias("baseline_total"),
            F.count_distinct(F.when(inside, F.col("raw_source"))).alias("cross_source"),
            F.coalesce(F.sum(F.when(inside, F.col("engagement"))), F.lit(0)).alias("engagement_sum"),
        )
        .where("short_count > 0")
    )


def scored(found: DataFrame, board: Board) -> DataFrame:
    """``measures`` with count_baseline (mentions an hour), growth_rate, final_score and is_new_entity; excluded names left out."""
    per_hour = F.col("baseline_total") / (board.baseline_days * 24 - board.hours)
    out = found.withColumn("count_baseline", per_hour)
    out = out.withColumn("growth_rate", growth(F.col("short_count"), F.col("count_baseline"), board.smoothing))
    out = out.withColumn("final_score", score(F.col("growth_rate"), F.col("cross_source"), board.cross_weight))
    out = out.withColumn("is_new_entity", (F.col("baseline_total") == 0) & (F.col("short_count") >= board.new_entity_count))
    return out.where(~F.upper("entity").isin([x.upper() for x in board.exclude])) if board.exclude else out


def enough(mentions: DataFrame, as_of: datetime.datetime, days: int, least: int) -> DataFrame:
    """One row, ``ok``: whether the baseline days hold ``least`` mentions."""
    rows = known(mentions, as_of).where(F.col("ts") >= _back(as_of, 24 * days))
    return rows.agg((F.count("*") >= least).alias("ok"), F.count("*").alias("n"))


def hotness_board(mentions: DataFrame, vocab: DataFrame | None, as_of: datetime.datetime, board: Board) -> DataFrame:
    """The ranked board of one window, empty when the baseline holds too few mentions.

    Order: final_score, then short_count, both falling, then the entity; a null final_score cannot arise.
    """
    ok = enough(mentions, as_of, board.baseline_days, board.min_baseline).select("ok")
    found = scored(measures(mentions, as_of, board), board)
    top = found.orderBy(F.desc("final_score"), F.desc("short_count"), "entity").limit(board.top_k)
    order = Window.orderBy(F.desc("final_score"), F.desc("short_count"), "entity")  # over top_k rows
    top = top.where(ok.scalar()).withColumn("rank", F.row_number().over(order))
    if vocab is not None:
        kinds = vocab.groupBy(F.col("name").alias("entity")).agg(F.min_by("entity_type", "ord").alias("entity_type"))
        top = top.join(kinds, "entity", "left").withColumn("entity_type", F.coalesce("entity_type", F.lit("ticker")))
    else:
        top = top.withColumn("entity_type", F.lit("ticker"))
    return top.select(
        at(quarter_of(as_of)).alias("window_end"), F.lit(board.window).alias("window_type"), "entity", "entity_type", F.col("short_count").alias("count_short"), "count_baseline", "growth_rate",
        "cross_source", "engagement_sum", "is_new_entity", "final_score", "rank",
    )


def _when(moment: datetime.datetime) -> str:
    return f"timestamp_ntz '{moment.isoformat(sep=' ')}'"


def hotness_boards(mentions: DataFrame, vocab: DataFrame, as_of: datetime.datetime, boards: tuple[Board, ...]) -> DataFrame:
    """``hotness_board`` of several windows, from one pass over the mentions and one ranking.

    Mentions are counted by entity and source, then by entity, so the distinct sources need no
    sets; the least baselines are asked of a second, narrow pass over the times alone.
    """
    end = quarter_of(as_of)
    first, second, gates, each, reach = [], [], [], [], as_of
    for i, b in enumerate(boards):
        short, start, base, whole = as_of - datetime.timedelta(hours=b.hours), end - datetime.timedelta(hours=b.hours), end - datetime.timedelta(days=b.baseline_days), as_of - datetime.timedelta(days=b.baseline_days)
        inside = f"ts >= {_when(start)} and ts < {_when(end)}"
        reach = min(reach, base, short)
        first += [
            f"count_if(ts >= {_when(short)}) as short_{i}", f"count_if(ts >= {_when(base)} and ts < {_when(start)}) as base_{i}",
            f"count_if({inside} and raw_source is not null) as in_{i}", f"sum(case when {inside} then engagement end) as sum_{i}",
        ]
        second += [f"sum(short_{i}) as short_{i}", f"sum(base_{i}) as base_{i}", f"count_if(in_{i} > 0) as cross_{i}", f"coalesce(sum(sum_{i}), 0) as sum_{i}"]
        gates.append(f"count_if(ts >= {_when(whole)}) >= {b.min_baseline} as g_{i}")
        each.append(
            f"named_struct('window_type', '{b.window}', 'top_k', {b.top_k}, 'short_count', short_{i}, 'baseline_total', base_{i}, 'cross_source', cross_{i}, 'engagement_sum', sum_{i}, "
            f"'count_baseline', base_{i} / {b.baseline_days * 24 - b.hours}d, 'smoothing', {float(b.smoothing)}d, 'weight', {float(b.cross_weight)}d, 'is_new_entity', base_{i} = 0 and short_{i} >= {b.new_entity_count}, 'board', {i})"
        )
    rows = known(mentions, as_of)
    aggs = lambda parts: [F.expr(x) for x in parts]
    open_ = rows.where(F.expr(f"ts >= {_when(min(as_of - datetime.timedelta(days=b.baseline_days) for b in boards))}")).agg(F.array(*(F.expr(g.rsplit(" as ", 1)[0]) for g in gates)).alias("g"))
    per = rows.where(F.expr(f"ts >= {_when(reach)}")).groupBy("entity", "raw_source").agg(*aggs(first)).groupBy("entity").agg(*aggs(second))
    found = per.select("entity", F.expr(f"inline(array({', '.join(each)}))")).where("short_count > 0").where(F.element_at(open_.scalar(), F.col("board") + 1))
    for i, b in enumerate(boards):
        if b.exclude:
            found = found.where((F.col("board") != i) | ~F.upper("entity").isin([x.upper() for x in b.exclude]))
    found = found.selectExpr("*", "short_count / greatest(count_baseline, smoothing) as growth_rate").selectExpr("*", "growth_rate * (1 + weight * (cross_source - 1)) as final_score")
    top = found.selectExpr("*", "row_number() over (partition by board order by final_score desc, short_count desc, entity) as rank").where(F.col("rank") <= max(b.top_k for b in boards)).where("rank <= top_k")
    kinds = vocab.groupBy(F.col("name").alias("entity")).agg(F.min_by("entity_type", "ord").alias("entity_type"))
    return top.join(kinds, "entity", "left").selectExpr(
        f"{_when(end)} as window_end", "window_type", "entity", "coalesce(entity_type, 'ticker') as entity_type", "short_count as count_short", "count_baseline", "growth_rate",
        "cross_source", "engagement_sum", "is_new_entity", "final_score", "rank",
    )


def snapshot_history(mentions: DataFrame, first: datetime.datetime, last: datetime.datetime, boards: tuple[Board, ...], step_hours: float) -> DataFrame:
    """Boards at every ``step_hours`` (whole quarters) from ``first`` to ``last`` (moments on a quarter): the same figures, all moments and boards in one pass.

    Mentions are first brought to (entity, source, quarter).  Each such cell is handed once to the
    moments that the longest short window reaches from it, whatever the number of boards; equal
    moments of an entity and source become one row in the task that made them.  The baselines are
    differences of the entity's running totals, so neither grows with their length, an entity has no
    more rows than there are quarters and sources, and none of this needs a second shuffle.
    """
    lo, hi = (int(x.replace(tzinfo=datetime.timezone.utc).timestamp()) // 900 for x in (first, last))
    step = round(step_hours * 4)
    if step < 1 or step != step_hours * 4:
        raise ValueError("moments lie on quarters of an hour")
    reach = max(round(b.hours * 4) for b in boards)
    cells = mentions.where("entity is not null and ts is not null").selectExpr("entity", "raw_source", "floor(unix_seconds(cast(ts as timestamp)) / 900) as m", "engagement")
    cells = cells.groupBy("entity", "raw_source", "m").agg(F.count("*").alias("n"), F.coalesce(F.sum("engagement"), F.lit(0)).alias("e"))
    # a cell at its own quarter (d = 0), and at every moment it may count for, d quarters later
    start = f"{lo} + ceil((greatest(m + 1, {lo}) - {lo}) / {step}d) * {step}"
    ends = f"case when {start} <= least({hi}, m + {reach}) then sequence({start}, cast(least({hi}, m + {reach}) as bigint), bigint({step})) else array() end"
    spread = cells.repartition(tasks(mentions.sparkSession), "entity").selectExpr("entity", "raw_source", "m as q", "n", "e", f"explode(concat(array(m), {ends})) as m")
    shorts = [round(b.hours * 4) for b in boards]
    kept = dict.fromkeys(shorts)
    inside = lambda k: f"m - q between 1 and {k}"
    by_source = spread.groupBy("entity", "raw_source", "m").agg(
        F.expr("sum(case when m = q then n else 0 end) as own"), F.expr("bool_or(m > q) as asked"), *(F.expr(f"sum(case when {inside(k)} then {x} else 0 end) as {x}_{k}") for k in kept for x in "ne")
    )
    per = by_source.groupBy("entity", "m").agg(
        F.sum("own").alias("own"), F.bool_or("asked").alias("asked"),
        *(F.expr(x) for k in kept for x in (f"sum(n_{k}) as short_{k}", f"count_if(n_{k} > 0 and raw_source is not null) as cross_{k}", f"sum(e_{k}) as sum_{k}")),
    )
    totals = sorted({k + 1 for b in boards for k in (round(b.hours * 4), b.baseline_days * 96)})
    per = per.selectExpr("*", *(f"coalesce(sum(own) over (partition by entity order by m range between unbounded preceding and {k} preceding), 0) as t_{k}" for k in totals)).where("asked")
    each = [
        f"named_struct('window_type', '{b.window}', 'top_k', {b.top_k}, 'short_count', short_{k}, 'cross_source', cross_{k}, 'engagement_sum', sum_{k}, 'baseline_total', t_{k + 1} - t_{b.baseline_days * 96 + 1}, "
        f"'hours', {b.baseline_days * 24 - b.hours}d, 'smoothing', {float(b.smoothing)}d, 'weight', {float(b.cross_weight)}d, 'new_count', {b.new_entity_count}, 'board', {i})"
        for i, (b, k) in enumerate(zip(boards, shorts))
    ]
    g = per.select("entity", "m", F.expr(f"inline(array({', '.join(each)}))")).where("short_count > 0")
    for i, b in enumerate(boards):
        if b.exclude:
            g = g.where((F.col("board") != i) | ~F.upper("entity").isin([x.upper() for x in b.exclude]))
    g = g.selectExpr("*", "baseline_total / hours as count_baseline").selectExpr("*", "short_count / greatest(count_baseline, smoothing) as growth_rate").selectExpr("*", "growth_rate * (1 + weight * (cross_source - 1)) as final_score")
    g = g.selectExpr("*", "row_number() over (partition by m, board order by final_score desc, short_count desc, entity) as rank").where(F.col("rank") <= max(b.top_k for b in boards)).where("rank <= top_k")
    return g.selectExpr(
        "cast(timestamp_seconds(m * 900) as timestamp_ntz) as window_end", "window_type", "entity", "short_count as count_short", "count_baseline", "growth_rate", "cross_source", "engagement_sum",
        "baseline_total = 0 and short_count >= new_count as is_new_entity", "final_score", "rank",
    )
