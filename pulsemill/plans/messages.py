"""Queries on raw posts and normalized messages, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as x
from ..operators import fingerprints as fp
from ..operators import ingest, keyed
from ..operators import normalize as n
from ..operators.hotness import at
from ..session import fresh_path, spread
from ..sources.tables import table
from .registry import register

MOMENT = datetime.datetime(2020, 4, 20, 18, 0)
_RAW = {"twitter": "twitter_posts", "binance_square": "binance_square_posts", "discord": "discord_messages"}
_STRIP = r"regexp_replace({}, '^[\t\n\x0B\f\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\t\n\x0B\f\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "normalized_messages")


def vocabulary(spark: SparkSession, sf_dir: str) -> x.Vocabulary:
    return x.Vocabulary.of(table(spark, sf_dir, "vocab"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.all_posts(*(table(spark, sf_dir, t) for t in _RAW.values()))


_AUTHOR = {"discord": "'#' || channel_name || ' @' || username"}
_POSTS = "\nunion all ".join(f"select '{s}' raw_source, id raw_id, content, {_AUTHOR.get(s, 'author')} author, coalesce(posted_at, created_at) ts, created_at from {t}" for s, t in _RAW.items())

for _s, _t in _RAW.items():
    register(
        f"scan_{_s}",
        lambda spark, d, s=_s, t=_t: n.unseen(n.posts_of(table(spark, d, t), s), messages(spark, d)),
        f"select * from ({_POSTS}) p where raw_source = '{_s}' and not exists (select 1 from normalized_messages m where m.raw_source = p.raw_source and m.raw_id = p.raw_id)",
    )
register(
    "scan_fifo_batch",
    lambda spark, d: n.unseen(_posts(spark, d), messages(spark, d), batch=500).select("raw_source", "raw_id", "ts"),
    f"select raw_source, raw_id, ts from ({_POSTS}) p where not exists (select 1 from normalized_messages m where m.raw_source = p.raw_source and m.raw_id = p.raw_id) order by created_at, raw_id limit 500",
)
register(
    "normalize_posts",
    lambda spark, d: n.normalized_rows(_posts(spark, d)),
    f"select raw_source, raw_id, {_STRIP.format('content')} as text, author, 1.0::double author_weight, ts, 0 engagement from ({_POSTS}) where {_STRIP.format('content')} <> ''",
)
register("raw_ids_in_source", lambda spark, d: messages(spark, d).where("raw_source = 'discord'").select("raw_id").distinct(), "select distinct raw_id from normalized_messages where raw_source = 'discord'")
register("author_concat", lambda spark, d: n.posts_of(table(spark, d, "discord_messages"), "discord").groupBy("author").agg(F.count("*").alias("n")), "select '#' || channel_name || ' @' || username author, count(*) n from discord_messages group by 1")
register("unprocessed_l1", lambda spark, d: n.unprocessed(messages(spark, d)).select("id", "ts"), "select id, ts from normalized_messages where not is_duplicate and l1_processed_at is null")
register(
    "recent_simhashes",
    lambda spark, d: messages(spark, d).where((F.col("ts") >= at(MOMENT - datetime.timedelta(days=1))) & F.col("simhash").isNotNull() & ~F.col("is_duplicate")).select("id", "simhash", "ts"),
    "select id, simhash, ts from normalized_messages where ts >= timestamp '2020-04-19 18:00:00' and simhash is not null and not is_duplicate",
)
register("mentions_since", lambda spark, d: table(spark, d, "entity_mentions").where(F.col("ts") >= at(MOMENT)).select("entity", "ts"), "select entity, ts from entity_mentions where ts >= timestamp '2020-04-20 18:00:00'")

# ---- fingerprints ----


def _simhash_sql(rows: str) -> str:
    """Common tables that give ``u`` (id, v): the fingerprint of each (id, text) of ``rows``, v without sign."""
    return rf"""t as (select id, array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), '') s from {rows} where text is not null),
g as (select id, substr(s, i::bigint, 4) f, count(*) w from (select id, s, unnest(generate_series(1, greatest(length(s) - 3, 1))) i from t) group by 1, 2),
h as (select id, w, ('0x' || substr(md5(f), 17))::ubigint v from g),
u as (select id, {" + ".join(f"case when sum(w) filter (where v & {1 << k}::ubigint <> 0) * 2 > sum(w) then {1 << k}::hugeint else 0::hugeint end" for k in range(64))} v from h group by 1)
"""


_SIGNED = "(case when u.v >= 9223372036854775808::hugeint then u.v - 18446744073709551616::hugeint else u.v end)::bigint"
register(
    "simhash64",
    lambda spark, d: spread(messages(spark, d).where("text is not null").select("id", "text")).select("id", fp.simhash64("text").alias("simhash")),
    f"with {_simhash_sql('normalized_messages')} select id, {_SIGNED} simhash from u",
)
register(
    "simhash_check",
    lambda spark, d: spread(messages(spark, d).where("simhash is not null").select("text", "simhash")).select(F.count_if(fp.simhash64("text") == F.col("simhash")).alias("same"), F.count("*").alias("n")),
    "select count(*) same, count(*) n from normalized_messages where simhash is not null",
)
_NEAR = """
with p as (select id, simhash, ts, epoch(ts)::bigint // 3600 b from normalized_messages where simhash is not null and ts is not null),
m as (select x.id msg_id, y.id prior_id, y.ts prior_ts, y.b prior_bucket, bit_count(xor(x.simhash, y.simhash))::int distance from p x join p y
 on y.b between x.b - 24 and x.b and (y.ts < x.ts or y.ts = x.ts and y.id < x.id) where bit_count(xor(x.simhash, y.simhash)) <= 3)
"""
register("near_dups", lambda spark, d: fp.near_duplicates(messages(spark, d)).select("msg_id", "prior_id", "distance"), _NEAR + "select msg_id, prior_id, distance from m")
register("dup_of", lambda spark, d: fp.duplicate_of(messages(spark, d)), _NEAR + "select msg_id, arg_min(prior_id, (prior_bucket, prior_ts, prior_id)) dup_of from m group by 1")
register(
    "hamming_pairs",
    lambda spark, d: messages(spark, d).where("dup_of is not null").select("id", "dup_of", "simhash").join(messages(spark, d).select(F.col("id").alias("dup_of"), F.col("simhash").alias("other")), "dup_of").select("id", "dup_of", fp.hamming("simhash", "other").cast("int").alias("distance")),
    "select a.id, a.dup_of, bit_count(xor(a.simhash, b.simhash))::int distance from normalized_messages a join normalized_messages b on b.id = a.dup_of",
)

# ---- rules and entities ----

_T = f"with t as (select id, {_STRIP.format('coalesce(text, $$$$)')} s from normalized_messages)\n"
_SYMBOL = x.SYMBOL
_WHY = (
    _T
    + f""", v as (select '(^|[^A-Za-z0-9])(' || coalesce(string_agg(distinct name, '|') filter (where entity_type = 'ticker' and regexp_full_match(name, '[ -~]+')), 'a^') || ')([^A-Za-z0-9]|$)' en,
 coalesce(string_agg(distinct alias, '|') filter (where entity_type = 'ticker' and regexp_matches(alias, '[一-鿿]')), 'a^') zh from vocab),
w as (select id, case when regexp_matches(s, '{_SYMBOL}') then 'A:$symbol' when regexp_matches(s, (select en from v), 'i') or regexp_matches(s, (select zh from v)) then 'B:coin_dict'
 when length(s) < 20 then 'D:length<20' when length(s) < 35 and regexp_matches(s, '{"|".join(x.NOISE)}', 'i') then 'E:short_noise'
 when length(s) >= 50 and regexp_matches(s, '\\p{{Nd}}') then 'C:long+num' when length(s) >= 25 and regexp_matches(s, '\\p{{Nd}}') and regexp_matches(s, '[%％]') then 'F:mid+num+pct' else 'default' end reason from t)
"""
)
register("dollar_hits", lambda spark, d: messages(spark, d).select("id", x.symbol_hits(F.col("text")).alias("hits")).where(F.size("hits") > 0), f"select id, hits from (select id, regexp_extract_all(text, '{_SYMBOL}', 1) hits from normalized_messages) where len(hits) > 0")
register("classify_reasons", lambda spark, d: messages(spark, d).select("id", x.reason(F.col("text"), vocabulary(spark, d)).alias("reason")), _WHY + "select id, reason from w")
register(
    "keep_drop_split",
    lambda spark, d: messages(spark, d).select(x.reason(F.col("text"), vocabulary(spark, d)).alias("reason")).select("reason", x.keeps(F.col("reason")).alias("keep")).groupBy("keep", "reason").agg(F.count("*").alias("n")),
    _WHY + "select reason[1] in ('A', 'B', 'C', 'F') keep, reason, count(*) n from w group by 1, 2",
)


def coin_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    return messages(spark, sf_dir).where(F.col("text").rlike(v.latin_pattern() or "a^") | F.col("text").rlike(v.ideograph_pattern() or "a^")).select("id")


register("coin_hits", coin_hits, _WHY + "select id from t where regexp_matches(s, (select en from v), 'i') or regexp_matches(s, (select zh from v))")

# addresses: RE2 has no look-around, so runs of the alphabet are taken whole and measured
_PATTERNS = (
    _T
    + f""", r as (select id, 0 prio, upper(h) as name, 'ticker' entity_type, i ord from (select id, unnest(regexp_extract_all(s, '{_SYMBOL}', 1)) h, generate_subscripts(regexp_extract_all(s, '{_SYMBOL}', 1), 1) i from t) where not regexp_matches(h, '^[0-9]')
union all select id, 1, right(h, 42), 'project', i from (select id, unnest(regexp_extract_all(s, '[a-fA-F0-9]*0x[a-fA-F0-9]+')) h, generate_subscripts(regexp_extract_all(s, '[a-fA-F0-9]*0x[a-fA-F0-9]+'), 1) i from t) where length(h) = 42
union all select id, 2, h, 'project', i from (select id, unnest(regexp_extract_all(s, '[1-9A-HJ-NP-Za-km-z]+')) h, generate_subscripts(regexp_extract_all(s, '[1-9A-HJ-NP-Za-km-z]+'), 1) i from t) where length(h) between 32 and 44),
d as (select distinct t.id, v.name, v.entity_type from t join vocab v on contains(lower(t.s), lower(v.alias)))
"""
)
register(
    "regex_entities",
    lambda spark, d: messages(spark, d).select("id", F.explode(x.pattern_entities(n.clean_text("text"))).alias("e")).groupBy("id", "e.name", "e.entity_type").agg(F.count("*").alias("n")),
    _PATTERNS + "select id, name, entity_type, count(*) n from r group by all",
)
register(
    "dict_entities",
    lambda spark, d: messages(spark, d).select("id", F.explode(x.dictionary_entities(n.clean_text("text"), vocabulary(spark, d))).alias("e")).select("id", "e.name", "e.entity_type"),
    _PATTERNS + "select id, name, entity_type from d",
)
_MERGED = ", e as (select id, name, entity_type, 1.0::double confidence from d union all (select id, name, arg_min(entity_type, prio), 0.95::double from r where not exists (select 1 from d where d.id = r.id and d.name = r.name) group by id, name))\n"
register(
    "merged_entities",
    lambda spark, d: spread(messages(spark, d).select("id", "text")).select("id", x.entities(n.clean_text("text"), vocabulary(spark, d)).alias("entities")).select("id", F.explode("entities").alias("e")).select("id", "e.name", "e.entity_type", "e.confidence"),
    _PATTERNS + _MERGED + "select id, name, entity_type, confidence from e",
)
register(
    "mention_rows",
    lambda spark, d: x.mention_rows(messages(spark, d), vocabulary(spark, d), table(spark, d, "vocab").where("entity_type = 'chain'").select(F.lower("name").alias("name"))),
    _PATTERNS + _MERGED + """select m.id msg_id, e.name entity, e.entity_type, m.raw_source, m.ts, m.engagement, m.author_weight, e.confidence,
lower(coalesce(m.author, '')) in (select lower(name) from vocab where entity_type = 'chain') is_kol_mention from e join normalized_messages m on m.id = e.id where not m.is_duplicate and m.text is not null""",
)


def kol_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a mention, and whether their author is one of those with 30 messages or more."""
    who = messages(spark, sf_dir).where("author is not null").groupBy(F.lower("author").alias("name")).agg(F.count("*").alias("n")).where("n >= 30")
    return x.mention_rows(messages(spark, sf_dir), vocabulary(spark, sf_dir), who).select("msg_id", "is_kol_mention").distinct()


register(
    "kol_flag",
    kol_flag,
    _PATTERNS + _MERGED + """select distinct m.id msg_id, coalesce(lower(m.author) in (select lower(author) from normalized_messages where author is not null group by 1 having count(*) >= 30), false) is_kol_mention
from e join normalized_messages m on m.id = e.id where not m.is_duplicate and m.text is not null""",
)
register(
    "name_conflicts",
    lambda spark, d: x.name_conflicts(table(spark, d, "entity_mentions"), "entity"),
    "select entity as name, list_sort(list(distinct entity_type)) kinds from entity_mentions where entity is not null and entity_type is not null group by 1 having count(distinct entity_type) > 1",
)
register("vocab_conflicts", lambda spark, d: x.conflicts(table(spark, d, "vocab").unionByName(table(spark, d, "vocab").where("ord < 5").withColumn("name", F.concat("name", F.lit("_2"))))), "select lower(alias) alias, list_sort(list(distinct name)) as names from (select alias, name from vocab union all select alias, name || '_2' from vocab where ord < 5) group by 1 having count(distinct name) > 1")
register("alias_index", lambda spark, d: table(spark, d, "vocab").groupBy(F.lower("alias").alias("alias")).agg(F.min_by("name", "ord").alias("name"), F.min_by("entity_type", "ord").alias("entity_type"), F.min("ord").alias("ord")), "select lower(alias) alias, arg_min(name, ord) as name, arg_min(entity_type, ord) entity_type, min(ord) ord from vocab group by 1")

# ---- writes by key ----

_COLS = "msg_id, entity, confidence, ts"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table with unique keys of the earlier mentions, and all later ones with the last days of the earlier."""
    m = table(spark, sf_dir, "entity_mentions").select("msg_id", "entity", "confidence", "ts")
    old = m.where(F.col("ts") < at(datetime.datetime(2020, 4, 10))).groupBy("msg_id", "entity").agg(F.min(F.struct("confidence", "ts")).alias("r")).select("msg_id", "entity", "r.*")
    return old, m.where(F.col("ts") >= at(datetime.datetime(2020, 4, 5)))


_TWO = f"""with old as (select msg_id, entity, r.confidence, r.ts from (select msg_id, entity, min(struct_pack(confidence := confidence, ts := ts)) r from entity_mentions where ts < timestamp '2020-04-10' group by 1, 2)),
new as (select {_COLS} from entity_mentions where ts >= timestamp '2020-04-05')\n"""
register(
    "insert_ignore",
    lambda spark, d: keyed.insert_ignore(*_two(spark, d), ["msg_id", "entity"]),
    _TWO + f"select {_COLS} from old union all select msg_id, entity, r.confidence, r.ts from (select msg_id, entity, min(struct_pack(confidence := confidence, ts := ts)) r from new group by 1, 2) n where not exists (select 1 from old o where o.msg_id = n.msg_id and o.entity = n.entity)",
)


def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two(spark, sf_dir)
    return keyed.upsert(old, new.groupBy("msg_id", "entity").agg(F.max("confidence").alias("confidence"), F.max("ts").alias("ts")), ["msg_id", "entity"])


register("upsert_update", upsert_update, _TWO + f", n as (select msg_id, entity, max(confidence) confidence, max(ts) ts from new group by 1, 2) select {_COLS} from n union all select {_COLS} from old o where not exists (select 1 from n where o.msg_id = n.msg_id and o.entity = n.entity)")
register(
    "mark_processed",
    lambda spark, d: keyed.mark_processed(messages(spark, d), messages(spark, d).where("not is_duplicate").select("id"), at(MOMENT)).select("id", "l1_processed_at"),
    "select id, case when not is_duplicate then coalesce(l1_processed_at, timestamp '2020-04-20 18:00:00') else l1_processed_at end l1_processed_at from normalized_messages",
)


# ---- the composed steps ----


def _store(spark: SparkSession) -> ingest.Store:
    return ingest.Store.at(spark, fresh_path(spark, "store"), parts=8)


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw posts taken into an empty store, then all of them again, which adds nothing."""
    store = _store(spark)
    for _ in range(2):
        ingest.ingest(store, _posts(spark, sf_dir))
    return store.messages.read().select("id", "raw_source", "raw_id", "ts", "simhash", "is_duplicate", "dup_of", "l1_processed_at")


def extract_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of all messages, as if none had been processed; a second run finds none to process."""
    store = _store(spark)
    store.messages.insert_ignore(messages(spark, sf_dir).withColumn("l1_processed_at", F.lit(None).cast("timestamp_ntz")))
    vocab = vocabulary(spark, sf_dir)
    for _ in range(2):
        ingest.extract(store, vocab, MOMENT)
    done = store.messages.read().select(F.col("id").alias("msg_id"), F.col("l1_processed_at").alias("done"))
    return store.mentions.read().join(done, "msg_id").select("msg_id", "entity", "entity_type", "confidence", "is_kol_mention", "done")


_KEYED_POSTS = f"""p as (select *, {_STRIP.format('content')} as text, (case raw_source when 'twitter' then 0 when 'binance_square' then 1 else 2 end) * 72057594037927936 + raw_id id from ({_POSTS})),
k as (select * from p where text <> '')"""
register(
    "ingest_twice",
    ingest_twice,
    f"""with {_KEYED_POSTS}, {_simhash_sql('k')},
f as (select k.id, k.raw_source, k.raw_id, k.ts, {_SIGNED} simhash, epoch(k.ts)::bigint // 3600 b from k join u on u.id = k.id),
m as (select x.id msg_id, arg_min(y.id, (y.b, y.ts, y.id)) dup_of from f x join f y on y.b between x.b - 24 and x.b and (y.ts < x.ts or y.ts = x.ts and y.id < x.id) where bit_count(xor(x.simhash, y.simhash)) <= 3 group by 1)
select f.id, raw_source, raw_id, ts, simhash, dup_of is not null is_duplicate, dup_of, null::timestamp l1_processed_at from f left join m on m.msg_id = f.id""",
)
_ONCE = "(select * from normalized_messages qualify row_number() over (partition by raw_source, raw_id order by id) = 1)"
register(
    "extract_twice",
    extract_twice,
    _PATTERNS + _MERGED + f"""select m.id msg_id, e.name entity, e.entity_type, e.confidence, false is_kol_mention, timestamp '{MOMENT}' done from e join {_ONCE} m on m.id = e.id where not m.is_duplicate and m.text is not null""",
)
register(
    "unprocessed_batch",
    lambda spark, d: n.unprocessed(messages(spark, d), 500).select("id", "ts"),
    "select id, ts from normalized_messages where not is_duplicate and l1_processed_at is null order by ts, id limit 500",
)
