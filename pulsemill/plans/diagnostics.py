"""Diagnostic queries over all tables, and rendered lines, with their SQL."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import render as r
from ..operators.hotness import align_to_quarter, at
from ..sources.tables import table
from . import boards, pairs
from .registry import register

NOW = datetime.datetime(2020, 4, 20, 18, 0)
_NOW = "timestamp '2020-04-20 18:00:00'"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_mentions")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_messages")


def _ago(hours: float):
    return at(NOW - datetime.timedelta(hours=hours))


_TABLES = {"twitter_posts": "created_at", "binance_square_posts": "created_at", "discord_messages": "created_at", "normalized_messages": "ts", "entity_mentions": "ts"}


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


register(
    "funnel_sources",
    lambda spark, d: _union(table(spark, d, t).agg(F.lit(t).alias("source"), F.count("*").alias("n")) for t in list(_TABLES)[:3]),
    " union all ".join(f"select '{t}' source, count(*) n from {t}" for t in list(_TABLES)[:3]),
)
register(
    "freshness",
    lambda spark, d: _union(table(spark, d, t).agg(F.lit(t).alias("source"), F.max(c).alias("newest"), F.count("*").alias("n")) for t, c in _TABLES.items()),
    " union all ".join(f"select '{t}' source, max({c}) newest, count(*) n from {t}" for t, c in _TABLES.items()),
)
register("dup_split", lambda spark, d: messages(spark, d).groupBy("is_duplicate").agg(F.count("*").alias("n")), "select is_duplicate, count(*) n from normalized_messages group by 1")
register(
    "mention_totals",
    lambda spark, d: mentions(spark, d).agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("msgs"), F.count_if(F.col("confidence") == 1.0).alias("dict"), F.count_if(F.col("confidence") < 1.0).alias("regex")),
    "select count(*) n, count(distinct msg_id) msgs, count(*) filter (where confidence = 1.0) dict, count(*) filter (where confidence < 1.0) regex from entity_mentions",
)


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    g = m.groupBy(F.coalesce("entity_type", F.lit("?")).alias("entity_type")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 1.0).alias("dict"))
    total = m.agg(F.count("*").alias("n")).scalar()
    return g.withColumn("share", r.percent(F.col("n"), total)).withColumn("bar", r.bar(F.col("n") / total))


register("type_distribution", type_distribution, "select coalesce(entity_type, '?') entity_type, count(*) n, count(*) filter (where confidence = 1.0) dict, format('{:.1f}', round(count(*) * 100.0 / (select count(*) from entity_mentions), 1)) share, repeat('█', round(count(*) / (select count(*) from entity_mentions) * 20)::int) bar from entity_mentions group by 1")


def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(F.col("ts") <= at(NOW))
    g = m.groupBy("raw_source").agg(*(F.count_if(F.col("ts") >= _ago(h)).alias(f"n_{n}") for n, h in (("24h", 24), ("1h", 1), ("10min", 1 / 6))), F.max("ts").alias("newest"))
    total = m.where(F.col("ts") >= _ago(24)).agg(F.count("*").alias("n")).scalar()
    return g.withColumn("share", F.round(F.col("n_24h") * 100.0 / F.nullif(total, F.lit(0)), 1))


_DIST = f"select raw_source, count(*) filter (where ts >= {_NOW} - interval 24 hour) n_24h, count(*) filter (where ts >= {_NOW} - interval 1 hour) n_1h, count(*) filter (where ts >= {_NOW} - interval 10 minute) n_10min, max(ts) newest from normalized_messages where ts <= {_NOW} group by 1"
register("source_distribution", source_distribution, f"select *, round(n_24h * 100.0::double / nullif(sum(n_24h) over (), 0), 1) share from ({_DIST})")


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("twitter",), ("binance_square",), ("discord",), ("reddit",)], "raw_source string")
    recent = messages(spark, d).where((F.col("ts") >= _ago(24)) & (F.col("ts") <= at(NOW))).select("raw_source").distinct()
    return expected.join(recent, "raw_source", "left_anti")


register("missing_sources", missing_sources, f"select * from (values ('twitter'), ('binance_square'), ('discord'), ('reddit')) v(raw_source) where raw_source not in (select raw_source from normalized_messages where ts between {_NOW} - interval 24 hour and {_NOW})")
for _h in (1, 24):
    register(
        f"top_entities_{_h}h",
        lambda spark, d, h=_h: mentions(spark, d).where((F.col("ts") >= _ago(h)) & (F.col("ts") <= at(NOW))).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20),
        f"select entity, count(*) n from entity_mentions where ts >= {_NOW} - interval {_h} hour and ts <= {_NOW} group by 1 order by n desc, entity limit 20",
    )


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a day by source with their mentions of the last hours joined on: rows of the join, and messages hit."""
    m = messages(spark, d).where((F.col("ts") >= _ago(24)) & (F.col("ts") < at(NOW))).select("id", "raw_source")
    e = mentions(spark, d).where(F.col("ts") >= _ago(12)).select("msg_id")
    j = m.join(e, F.col("msg_id") == F.col("id"), "left").groupBy("raw_source").agg(F.count("*").alias("total"), F.count_distinct("id").alias("total_msgs"), F.count_distinct("msg_id").alias("hit"))
    return j.withColumn("hit_share", r.percent(F.col("hit"), F.col("total")))


register("source_stats", source_stats, f"""select m.raw_source, count(*) total, count(distinct m.id) total_msgs, count(distinct e.msg_id) hit, format('{{:.1f}}', round(count(distinct e.msg_id) * 100.0 / count(*), 1)) hit_share
from normalized_messages m left join entity_mentions e on e.msg_id = m.id and e.ts >= {_NOW} - interval 12 hour where m.ts >= {_NOW} - interval 24 hour and m.ts < {_NOW} group by 1""")
register(
    "unmatched_audit",
    lambda spark, d: messages(spark, d).where("l1_processed_at is not null and not is_duplicate").join(mentions(spark, d).select(F.col("msg_id").alias("id")), "id", "left_anti").select("id", "raw_source"),
    "select id, raw_source from normalized_messages m where l1_processed_at is not null and not is_duplicate and not exists (select 1 from entity_mentions e where e.msg_id = m.id)",
)
register(
    "random_audit",
    lambda spark, d: messages(spark, d).where("l1_processed_at is not null and not is_duplicate").orderBy(F.rand()).limit(20).select("id"),
    None,
)
register(
    "narrative_hits",
    lambda spark, d: mentions(spark, d).where((F.col("entity_type") == "narrative") & (F.col("ts") >= _ago(24 * 7)) & (F.col("ts") <= at(NOW))).groupBy("entity").agg(F.count("*").alias("n")),
    f"select entity, count(*) n from entity_mentions where entity_type = 'narrative' and ts >= {_NOW} - interval 168 hour and ts <= {_NOW} group by 1",
)
register(
    "ingest_rate",
    lambda spark, d: messages(spark, d).groupBy("raw_source", F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")),
    "select raw_source, date_trunc('hour', created_at) as \"hour\", count(*) n from normalized_messages group by 1, 2",
)
register(
    "type_hits",
    lambda spark, d: mentions(spark, d).groupBy("entity_type", F.when(F.col("confidence") == 1.0, "dict").otherwise("regex").alias("hit")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities")),
    "select entity_type, case when confidence = 1.0 then 'dict' else 'regex' end hit, count(*) n, count(distinct entity) entities from entity_mentions group by 1, 2",
)


def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Shares along the funnel, from raw posts to mentions, in one row."""
    raw = _union(table(spark, d, t).select(F.lit(1).alias("x")) for t in list(_TABLES)[:3]).agg(F.count("*").alias("raw"))
    m = messages(spark, d).agg(F.count("*").alias("normalized"), F.count_if("is_duplicate").alias("duplicates"))
    e = mentions(spark, d).agg(F.count_distinct("msg_id").alias("hit"), F.count_if(F.col("confidence") == 1.0).alias("dict"), F.count("*").alias("mentions"))
    one = raw.withColumns({c: m.select(c).scalar() for c in m.columns} | {c: e.select(c).scalar() for c in e.columns})
    return one.select("*", r.percent(F.col("normalized"), F.col("raw")).alias("normalized_share"), r.percent(F.col("duplicates"), F.col("normalized")).alias("duplicate_share"), r.percent(F.col("hit"), F.col("normalized")).alias("hit_share"), r.percent(F.col("dict"), F.col("mentions")).alias("dict_share"))


_P = lambda a, b: f"format('{{:.1f}}', round({a} * 100.0 / {b}, 1))"
register("diagnosis", diagnosis, f"""with a as (select (select count(*) from twitter_posts) + (select count(*) from binance_square_posts) + (select count(*) from discord_messages) raw),
b as (select count(*) normalized, count(*) filter (where is_duplicate) duplicates from normalized_messages), c as (select count(distinct msg_id) hit, count(*) filter (where confidence = 1.0) dict, count(*) mentions from entity_mentions)
select *, {_P('normalized', 'raw')} normalized_share, {_P('duplicates', 'normalized')} duplicate_share, {_P('hit', 'normalized')} hit_share, {_P('dict', 'mentions')} dict_share from a, b, c""")


def diagnosis_flags(spark: SparkSession, d: str) -> DataFrame:
    """What stands out in the funnel, as one row's list."""
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))
    flags = (
        F.when(share("normalized", "raw") < 0.5, "few normalized"),
        F.when(share("duplicates", "normalized") > 0.6, "many duplicates").when((F.col("normalized") > 100) & (share("duplicates", "normalized") < 0.05), "few duplicates"),
        F.when(share("hit", "normalized") < 0.1, "hardly any hits").when(share("hit", "normalized") < 0.3, "few hits"),
        F.when(share("dict", "mentions") < 0.3, "few by dictionary"),
    )
    return diagnosis(spark, d).select(F.array_compact(F.array(*flags)).alias("flags"))


register("diagnosis_flags", diagnosis_flags, """with f as (select (select count(*) from twitter_posts) + (select count(*) from binance_square_posts) + (select count(*) from discord_messages) raw,
(select count(*) from normalized_messages) n, (select count(*) from normalized_messages where is_duplicate) d, (select count(distinct msg_id) from entity_mentions) h,
(select count(*) from entity_mentions where confidence = 1.0) x, (select count(*) from entity_mentions) m)
select list_filter([case when n / raw < 0.5 then 'few normalized' end, case when d / n > 0.6 then 'many duplicates' when n > 100 and d / n < 0.05 then 'few duplicates' end,
case when h / n < 0.1 then 'hardly any hits' when h / n < 0.3 then 'few hits' end, case when x / m < 0.3 then 'few by dictionary' end], lambda v: v is not null) flags from f""")


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Mentions written as JSON, their fields read by path and counted."""
    j = mentions(spark, d).select(F.to_json(F.struct("entity", "entity_type", "confidence")).alias("j"))
    at = lambda name: F.get_json_object("j", f"$.{name}").alias(name)
    return j.select(at("entity"), at("entity_type"), at("confidence").cast("double").alias("confidence")).groupBy("entity", "entity_type", "confidence").agg(F.count("*").alias("n"))


register("json_fields", json_fields, "select entity, entity_type, confidence, count(*) n from entity_mentions group by all")
register(
    "latest_scalar_subquery",
    lambda spark, d: mentions(spark, d).where(F.to_date("ts") == mentions(spark, d).agg(F.max(F.to_date("ts"))).scalar()).groupBy("entity").agg(F.count("*").alias("n")),
    "select entity, count(*) n from entity_mentions where ts::date = (select max(ts)::date from entity_mentions) group by 1",
)


def threshold_pass(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([("1h", 0.5), ("3h", 1.0), ("6h", 1.0), ("24h", 2.0)], "window_type string, least double")
    h = boards.history(spark, d).join(F.broadcast(levels), "window_type")
    return h.groupBy("window_type", "least").agg(F.count_if(F.col("growth_rate") >= F.col("least")).alias("passed"), F.count("*").alias("n"))


register("threshold_pass", threshold_pass, boards.HISTORY + "select window_type, least, count(*) filter (where growth_rate >= least) passed, count(*) n from hist join (values ('1h', 0.5::double), ('3h', 1.0), ('6h', 1.0), ('24h', 2.0)) v(window_type, least) using (window_type) group by 1, 2")

# ---- rendered lines ----


def digest_lines(spark: SparkSession, d: str) -> DataFrame:
    b = boards._board(boards._OPEN)(spark, d).where("rank <= 10")
    return b.select("rank", r.digest_line(F.col("rank"), F.col("entity"), F.col("entity_type"), F.col("growth_rate"), F.col("count_short"), F.col("cross_source"), F.col("is_new_entity")).alias("line"))


register("digest_lines", digest_lines, f"""select rank, format('{{}}. `{{}}` ({{}}) growth={{:.1f}}x 提及={{}} 跨源={{}}', rank, regexp_replace(entity, '([\\\\_*`\\[])', '\\\\\\1', 'g'), entity_type, growth_rate, count_short, cross_source) || case when is_new_entity then ' ★' else '' end line
from ({boards.board_sql(boards._OPEN)}) where rank <= 10""")
register(
    "digest_gate",
    lambda spark, d: mentions(spark, d).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.floor(F.minute("ts") / 15).cast("int").alias("q")).distinct().select("h", "q", *((F.col("q") * 15 % (15 * k) == 0).alias(f"due_{k}") for k in (1, 2, 3, 4))),
    "select distinct date_trunc('hour', ts) h, (minute(ts) // 15)::int q, " + ", ".join(f"((minute(ts) // 15) * 15) % {15 * k} = 0 due_{k}" for k in (1, 2, 3, 4)) + " from entity_mentions",
)
_EV = "(select * from normalized_messages m where exists (select 1 from entity_mentions e where e.msg_id = m.id and e.entity = 'RICAKI') order by engagement desc, id limit 10)"
register("evidence_topn", lambda spark, d: r.evidence(messages(spark, d), mentions(spark, d), "RICAKI", 10).select("id", "engagement"), f"select id, engagement from {_EV}")
register(
    "evidence_lines",
    lambda spark, d: r.evidence(messages(spark, d), mentions(spark, d), "RICAKI", 10).select("id", r.evidence_line(F.col("author"), F.col("ts"), F.col("text")).alias("line")),
    f"select id, '[' || coalesce(author, 'anon') || ' @ ' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 300) line from {_EV}",
)
register("hint_render", lambda spark, d: r.hint(pairs.neighbors(spark, d)), pairs._SQL + """select coalesce(string_agg(other || '（PMI ' || format('{:.2f}', pmi) || '）', '、' order by pmi desc, other), '（暂无）') hint from
(select case when entity_a = 'RICAKI' then entity_b else entity_a end other, round(pmi, 6) pmi from b where entity_a = 'RICAKI' or entity_b = 'RICAKI' order by b.pmi desc, other limit 3)""")


def json_parse(spark: SparkSession, d: str) -> DataFrame:
    """An answer made of each message's text, author and source, in the ways a model writes one, and read again: fenced, its sentiment bare or unknown, a list, or no JSON."""
    m = messages(spark, d).where("raw_source is not null")
    field = F.to_json(F.struct(F.col("text").alias("narrative"), F.col("author").alias("catalyst"), F.lit(" ").alias("fund_logic"), F.col("author_weight").cast("string").alias("confidence")), {"ignoreNullFields": "false"})
    said = F.when(F.col("raw_source") == "twitter", F.lit('"bullish"')).when(F.col("raw_source") == "discord", F.lit("neutral")).otherwise(F.lit('"odd"'))
    whole = F.concat(F.expr("substring(f, 1, length(f) - 1)"), F.lit(', "sentiment": '), said, F.lit("}"))
    raw = F.when(F.col("is_duplicate"), F.concat(F.lit("["), whole, F.lit("]"))).when(F.col("author").isNull(), F.col("text")).when(F.col("raw_source") == "binance_square", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return m.withColumn("f", field).select("id", r.parsed_answer(raw).alias("p")).select("id", "p.valid", "p.sentiment", "p.confidence", F.length("p.narrative").alias("narrative_chars"), F.col("p.catalyst").alias("catalyst"), "p.fund_logic")


_VALID = "(not is_duplicate and author is not null)"
register("json_parse", json_parse, rf"""select id, {_VALID} "valid", case when {_VALID} then case raw_source when 'twitter' then 'bullish' when 'discord' then 'neutral' end end sentiment, case when {_VALID} then author_weight end confidence,
case when {_VALID} then nullif(length(regexp_replace(text, '^\s+|\s+$', '', 'g')), 0)::int end narrative_chars, case when {_VALID} then nullif(trim(author), '') end catalyst, null::varchar fund_logic from normalized_messages where raw_source is not null""")


def evidence_block(spark: SparkSession, d: str) -> DataFrame:
    rows = r.evidence(messages(spark, d), mentions(spark, d), "RICAKI", 10).select("id", "engagement", r.evidence_line(F.col("author"), F.col("ts"), F.col("text")).alias("line"))
    return r.evidence_block(rows, [F.desc("engagement"), F.col("id")])


register("evidence_block", evidence_block, f"""select string_agg('[' || coalesce(author, 'anon') || ' @ ' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 300), E'\\n\\n' order by engagement desc, id) as block from {_EV}""")
register(
    "local_times",
    lambda spark, d: messages(spark, d).where("ts is not null").groupBy(r.local_time(F.col("ts"), "Asia/Shanghai").alias("minute"), r.local_time(F.col("ts"), "Asia/Shanghai", True).alias("clock")).agg(F.count("*").alias("n")),
    "select strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') as \"minute\", strftime(ts + interval 8 hour, '%H:%M') clock, count(*) n from normalized_messages where ts is not null group by 1, 2",
)


def laggard_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with some, but under 5 %, of the last day's messages."""
    return source_distribution(spark, d).where("n_24h > 0 and share < 5").select("raw_source", "n_24h", "share")


register("laggard_sources", laggard_sources, f"select raw_source, n_24h, share from (select *, round(n_24h * 100.0::double / nullif(sum(n_24h) over (), 0), 1) share from ({_DIST})) where n_24h > 0 and share < 5")
register(
    "ingest_rate_10min",
    lambda spark, d: messages(spark, d).where("created_at is not null").groupBy("raw_source", F.window(F.col("created_at").cast("timestamp"), "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("raw_source", F.col("w.start").cast("timestamp_ntz").alias("since"), "n"),
    "select raw_source, time_bucket(interval 10 minute, created_at) since, count(*) n from normalized_messages where created_at is not null group by 1, 2",
)
register(
    "sentiment_nulls_last",
    lambda spark, d: messages(spark, d).orderBy(F.desc_nulls_last("sentiment_score"), "id").limit(50).select("id", "sentiment_score"),
    "select id, sentiment_score from normalized_messages order by sentiment_score desc nulls last, id limit 50",
)


def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """For each mention its entity's newest 24 h snapshot of the twelve hours before it, if any: looked up once for each entity and quarter."""
    m = mentions(spark, d).select("msg_id", "entity", "ts").distinct().withColumn("q", align_to_quarter(F.col("ts")))
    h = boards.history(spark, d).where("window_type = '24h'").select("entity", F.col("window_end").alias("q"), F.struct("window_end", "growth_rate").alias("s"))
    asked = m.select("entity", "q").distinct().withColumn("asked", F.lit(True))
    past = Window.partitionBy("entity").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = asked.unionByName(h, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(past)).where("asked").select("entity", "q", "s")
    found = m.join(last, ["entity", "q"], "left").withColumn("s", F.when(F.col("s.window_end") > F.col("ts") - F.expr("interval 12 hours"), F.col("s")))
    return found.select("msg_id", "entity", "ts", F.col("s.window_end").alias("window_end"), F.round("s.growth_rate", 6).alias("growth_rate"))


register("asof_snapshot", asof_snapshot, boards.HISTORY + f""", u as (select distinct msg_id, entity, ts from entity_mentions)
select u.msg_id, u.entity, u.ts, case when h.window_end > u.ts - interval 12 hour then h.window_end end window_end, case when h.window_end > u.ts - interval 12 hour then round(h.growth_rate, 6) end growth_rate
from u asof left join (select * from hist where window_type = '24h') h on h.entity = u.entity and h.window_end <= u.ts""")
