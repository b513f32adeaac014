"""Known values of the reference operators, sinks, rendering and streaming runners."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import cooccurrence as co
from pulsemill.operators import extract as ex
from pulsemill.operators import fingerprints as fp
from pulsemill.operators import hotness as hot
from pulsemill.operators import keyed, normalize, render
from pulsemill.sources import connectors, notify
from pulsemill.streaming import dedup, windows, worker

NOW = dt.datetime(2024, 5, 1, 12, 7)
MENTIONS = "msg_id long, entity string, entity_type string, raw_source string, ts timestamp_ntz, engagement int, author_weight double, confidence double, is_kol_mention boolean"


def _mentions(spark, rows):
    """Rows of (msg_id, entity, source, ts)."""
    return spark.createDataFrame([(m, e, None, s, t, 1, 1.0, 1.0, False) for m, e, s, t in rows], MENTIONS)


def _ago(**k):
    return NOW - dt.timedelta(**k)


def test_growth_and_score(spark):
    one = spark.range(1)
    rate = lambda n, b, s: one.select(hot.growth(F.lit(n), F.lit(b), s)).first()[0]
    assert rate(900, 3340 / 167, 2.0) == pytest.approx(45.0)
    assert rate(5, 0.0, 2.0) == 2.5
    assert [round(rate(n, b, 2.0), 2) for n, b in ((4, 1.43), (3, 2.81), (2, 0.34))] == [2.0, 1.07, 1.0]
    assert [rate(n, 100 / 167, s) for n, s in ((40, 2.0), (60, 5.0), (80, 10.0))] == [20.0, 12.0, 8.0]
    assert one.select(hot.score(F.lit(1.0), F.lit(3), 0.3)).first()[0] == pytest.approx(1.6)


def test_boards_are_validated():
    for bad in ({"window": "2h"}, {"window": "24h", "baseline_days": 1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            hot.Board(**bad)
    for bad in ({"window": "3h"}, {"min_count": 0}, {"top_pairs": 0}):
        with pytest.raises(ValueError):
            co.PairBoard(**bad)


def test_board_order_new_entities_and_names(spark):
    rows = [(i, "A", "twitter", _ago(minutes=10 + i)) for i in range(13)]
    rows += [(100 + i, e, s, _ago(minutes=10 + i)) for e in ("B", "C") for i in range(10) for s in ("twitter",)]
    rows += [(200, "C", "discord", _ago(minutes=12)), (300, "old", "twitter", _ago(days=3)), (400, "later", "twitter", NOW + dt.timedelta(hours=1)), (500, None, "twitter", _ago(minutes=10))]
    m = _mentions(spark, rows)
    vocab = spark.createDataFrame([(0, "b", "B", "chain")], "ord int, alias string, name string, entity_type string")
    got = hot.hotness_board(m, vocab, NOW, hot.Board("1h", min_baseline=0)).orderBy("rank").collect()
    assert [(r["entity"], r["rank"]) for r in got] == [("C", 1), ("A", 2), ("B", 3)]
    assert [r["entity_type"] for r in got] == ["ticker", "ticker", "chain"] and all(r["is_new_entity"] for r in got)
    assert got[0]["final_score"] == pytest.approx(11 / 2 * 1.3) and got[0]["window_end"] == NOW.replace(minute=0)
    assert hot.hotness_board(m, vocab, NOW, hot.Board("1h", min_baseline=1000)).count() == 0
    left = hot.hotness_board(m, None, NOW, hot.Board("1h", min_baseline=0, exclude=("c",))).collect()
    assert {r["entity"] for r in left} == {"A", "B"}
    both = hot.hotness_boards(m, vocab, NOW, (hot.Board("1h", min_baseline=0), hot.Board("24h", smoothing=10.0, baseline_days=8, min_baseline=10**6)))
    assert sorted(map(tuple, both.select(*[c for c in got[0].asDict()]).collect()), key=lambda r: r[-1]) == [tuple(r) for r in got]


def test_sliding_counts(spark):
    rows = [(i, "A", "t", NOW - dt.timedelta(seconds=s)) for i, s in enumerate((10, 20, 30))] + [(9, "B", "t", _ago(seconds=7200)), (10, "B", "t", _ago(seconds=60)), (11, "OLD", "t", _ago(hours=48))]
    m = _mentions(spark, rows)
    got = {r["entity"]: (r["n_1h"], r["n_24h"], r["n_7d"]) for r in hot.sliding_counts(m, NOW).collect()}
    assert got == {"A": (3, 3, 3), "B": (1, 2, 2), "OLD": (0, 0, 1)}
    assert {r["entity"] for r in hot.active_entities(m, NOW, "24h").collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        hot.active_entities(m, NOW, "30min")


def test_history_equals_single_boards(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ABCDE"), r.choice(("x", "y")), _ago(minutes=r.randrange(60 * 24 * 12))) for i in range(600)]
    m = _mentions(spark, rows)
    end = NOW.replace(hour=12, minute=0)
    b = hot.Board("6h", smoothing=5.0, baseline_days=3, min_baseline=0)
    hist = hot.snapshot_history(m, end - dt.timedelta(hours=12), end, (b,), 6)
    for k in (0, 6, 12):
        at = end - dt.timedelta(hours=k)
        one = hot.hotness_board(m, None, at, b).select("entity", "count_short", "rank").collect()
        assert {tuple(x) for x in hist.where(F.col("window_end") == hot.at(at)).select("entity", "count_short", "rank").collect()} == {tuple(x) for x in one}


def test_history_of_the_whole_table(spark, tmp_path):
    import __spark_entry__ as entry

    first, last = dt.datetime(2020, 1, 5, 3, 50), dt.datetime(2020, 1, 16, 1, 10)
    rows = [(i, "EARLY", "x", first + dt.timedelta(minutes=i)) for i in range(3)]
    rows += [(10 + i, "SHORT", r, dt.datetime(2020, 1, 9, 2, 31 + i)) for i, r in enumerate("xyx")] + [(20, "LATE", "x", last)]
    _mentions(spark, rows).write.parquet(f"{tmp_path}/entity_mentions.parquet")
    hist = entry.queries()["snapshot_history"](spark, str(tmp_path)).collect()
    moments = lambda e, w: sorted(r["window_end"] for r in hist if r["entity"] == e and r["window_type"] == w)
    quarters = lambda start, n: [start + dt.timedelta(minutes=15 * i) for i in range(n)]
    assert {r["window_type"] for r in hist} == {"1h", "3h", "6h", "24h"}
    assert moments("EARLY", "3h") == quarters(dt.datetime(2020, 1, 5, 4), 12) and moments("LATE", "24h") == quarters(dt.datetime(2020, 1, 16, 1, 15), 1)
    assert moments("SHORT", "1h") == quarters(dt.datetime(2020, 1, 9, 2, 45), 4)
    assert {(r["count_short"], r["cross_source"]) for r in hist if r["entity"] == "SHORT"} == {(3, 2)}
    found = {(r["msg_id"], r["window_end"]) for r in entry.queries()["asof_snapshot"](spark, str(tmp_path)).collect()}
    assert found == {(0, None), (1, None), (2, None), (10, None), (11, None), (12, None), (20, None)}
    again = [*rows, (30, "SHORT", "x", dt.datetime(2020, 1, 9, 20, 7))]
    _mentions(spark, again).write.parquet(f"{tmp_path}/again/entity_mentions.parquet")
    found = {r["msg_id"]: r["window_end"] for r in entry.queries()["asof_snapshot"](spark, f"{tmp_path}/again").collect()}
    assert found[30] == dt.datetime(2020, 1, 9, 20, 0) and len(found) == len(again)


def test_pmi(spark):
    p = lambda *x: spark.range(1).select(co.pmi(*map(F.lit, x))).first()[0]
    assert round(p(12, 25, 18, 200), 3) == 1.674
    assert p(50, 100, 100, 200) == pytest.approx(0) and p(8, 10, 10, 200) == pytest.approx(math.log(16)) and p(0, 1, 1, 1) == 0.0


def test_pairs_and_new_ones(spark):
    rows = [(i, e, "t", _ago(hours=2)) for i in range(3) for e in "AB"] + [(3, e, "t", _ago(hours=2)) for e in "ABC"] + [(3, "A", "t", _ago(hours=2))]
    rows += [(100 + i, "Z", "t", _ago(hours=3)) for i in range(60)] + [(50 + i, e, "t", _ago(hours=1)) for i in range(3) for e in "XY"] + [(90, e, "t", _ago(days=3)) for e in "XY"]
    m, b = _mentions(spark, rows), co.PairBoard("24h", min_count=3, min_pmi=0.0, min_msgs=1)
    board = co.pair_board(m, NOW, b)
    got = {(r["entity_a"], r["entity_b"]): (r["cooccur_count"], r["is_new_pair"]) for r in co.with_new(board, m, NOW, b).collect()}
    assert got == {("A", "B"): (4, True), ("X", "Y"): (3, False)}
    assert co.pair_board(m, NOW, co.PairBoard(min_msgs=1000)).count() == 0
    assert [r["other"] for r in co.neighbors(board, "B", 5).collect()] == ["A"]
    assert co.capped(co.window_mentions(m, _ago(days=1), NOW), 2).where("msg_id = 3").count() == 2


VOCAB = [(0, "btc", "BTC", "ticker"), (1, "比特币", "BTC", "ticker"), (2, "eth", "ETH", "ticker"), (3, "以太坊", "ETH", "ticker"), (4, "defi summer", "DeFi", "narrative")]
REASONS = [
    ("$BTC 突破 $73000，机构 ETF 持仓占比突破 26%", "A:$symbol"),
    ("增持 9 BTC，均价九万五千", "B:coin_dict"),
    ("xBTCx 今天没有什么可以说的，明天也没有，后天再看", "default"),
    ("今天又是亏麻的一天", "D:length<20"),
    ("梭就完事了，反正也亏不到哪去，韭菜命运罢了", "E:short_noise"),
    ("央行降准 43.5%，股指普涨，科技板块表现强势，市场一片乐观", "F:mid+num+pct"),
    ("1" + "长" * 60, "C:long+num"),
    ("17岁的女孩为什么要纹这么多身？只有胳膊不行，满身都是", "default"),
    ("", "D:length<20"),
    (None, "D:length<20"),
]


def test_reasons(spark):
    v = ex.Vocabulary(tuple((a, n, k) for _, a, n, k in VOCAB))
    rows = spark.createDataFrame(REASONS, "text string, want string").select("text", "want", ex.reason(F.col("text"), v).alias("got")).collect()
    assert [(r["text"], r["got"]) for r in rows] == REASONS


def test_entities(spark):
    v = ex.Vocabulary.of(spark.createDataFrame(VOCAB, "ord int, alias string, name string, entity_type string"))
    evm, sol = "0xdAC17F958D2ee523a2206206994597C13D831ec7", "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"
    rows = [
        (1, "$BTC 比特币 稳了，今晚决胜", [("BTC", 1.0)]),
        (2, "$xyzabc 是个新币 $XYZABC", [("XYZABC", 0.95)]),
        (3, "今天比特币涨了 3%，以太坊也稳了", [("BTC", 1.0), ("ETH", 1.0)]),
        (4, "$0.0837 $95000 $1.5B $73K", []),
        (5, f"看 {evm} 和 {sol}", [(evm, 0.95), (sol, 0.95)]),
        (6, "", []),
        (7, None, []),
        (8, "DEFI SUMMER is back", [("DeFi", 1.0)]),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "id int, text string")
    got = {r["id"]: [(e["name"], e["confidence"]) for e in r["e"]] for r in df.select("id", ex.entities(F.col("text"), v).alias("e")).collect()}
    assert got == {i: w for i, _, w in rows}
    jvm = {r["id"]: {(e["name"], e["entity_type"]) for e in (r["p"] or [])} for r in df.select("id", ex.pattern_entities(F.col("text")).alias("p")).collect()}
    assert all(jvm[i] == set(ex._by_pattern(t or "")) for i, t, _ in rows)
    none = ex.Vocabulary(())
    assert df.select(ex.entities(F.col("text"), none).alias("e"), ex.reason(F.col("text"), none)).count() == 8


def test_every_kol_of_a_long_list_counts(spark):
    names = spark.range(ex.MOST_NAMES + 50).select("id", F.concat(F.lit("kol"), "id").alias("name"))
    m = names.selectExpr("id", "'x' raw_source", "timestamp_ntz'2024-01-01' ts", "0 engagement", "1.0d author_weight", "upper(name) author", "'BTC up' text", "false is_duplicate")
    got = ex.mention_rows(m, ex.Vocabulary((("btc", "BTC", "ticker"),)), names).groupBy("is_kol_mention").count().collect()
    assert [tuple(r) for r in got] == [(True, ex.MOST_NAMES + 50)]


def test_normalizing(spark):
    when = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, " \n\t　hi \x1f", "@a", None, when), (2, "   ", "@b", when, when), (3, None, "@c", when, when)], "id long, content string, author string, posted_at timestamp_ntz, created_at timestamp_ntz")
    posts = normalize.posts_of(raw, "twitter")
    assert [tuple(r) for r in normalize.normalized_rows(posts).collect()] == [("twitter", 1, "hi", "@a", 1.0, when, 0)]
    known = spark.createDataFrame([("twitter", 1), ("discord", 2)], "raw_source string, raw_id long")
    assert {r["raw_id"] for r in normalize.unseen(posts, known).collect()} == {2, 3}
    assert [r["raw_id"] for r in normalize.unseen(posts, known, 1).collect()] == [2]
    chat = spark.createDataFrame([(1, "c", "x", "general", "ann", when, when)], "id long, content string, post_id string, channel_name string, username string, posted_at timestamp_ntz, created_at timestamp_ntz")
    assert normalize.posts_of(chat, "discord").first()["author"] == "#general @ann"
    with pytest.raises(ValueError):
        normalize.posts_of(raw, "else")


def test_batches_hold_only_unseen_posts(spark, small):
    import __spark_entry__ as entry
    from pulsemill.sources.tables import table

    seen = {(r["raw_source"], r["raw_id"]) for r in table(spark, small, "normalized_messages").select("raw_source", "raw_id").collect()}
    got = {(r["raw_source"], r["raw_id"]) for r in entry.queries()["scan_fifo_batch"](spark, small).collect()}
    posts = {(s, r["id"]) for s, t in (("twitter", "twitter_posts"), ("binance_square", "binance_square_posts"), ("discord", "discord_messages")) for r in table(spark, small, t).select("id").collect()}
    assert got == posts - seen and 0 < len(got) <= 500


def test_fingerprints():
    a = "the protocol announced a new partnership with several globe wide banks and funds to settle trades on chain this quarter"
    b = a.replace("globe", "world")
    d = ((fp.simhash_of(a) ^ fp.simhash_of(b)) & (2**64 - 1)).bit_count()
    assert fp.simhash_of(a) == fp.simhash_of(a.upper()) and 0 < d < 16
    assert fp.simhash_of(None) is None and isinstance(fp.simhash_of(""), int)


def _prints(seed, n=300):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        h = r.choice(base)
        for _ in range(r.randrange(5)):
            h ^= 1 << r.randrange(64)
        rows.append((i, h - 2**64 if h >= 2**63 else h, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(60 * 80))))
    return rows


def _near(rows):
    hour = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
    return {
        (i, j, d) for i, h, t in rows for j, g, u in rows
        if (u, j) < (t, i) and hour(t) - 24 <= hour(u) <= hour(t) and (d := ((h ^ g) & (2**64 - 1)).bit_count()) <= 3
    }


def test_near_duplicates_equal_brute_force(spark):
    rows = _prints(5)
    df = spark.createDataFrame([*rows, (999, None, NOW), (998, 1, None)], "id long, simhash long, ts timestamp_ntz")
    assert {(r["msg_id"], r["prior_id"], r["distance"]) for r in fp.near_duplicates(df).collect()} == _near(rows)
    first = {}
    for i, j, _ in _near(rows):
        t = rows[j][2]
        key = (t.replace(minute=0), t, j)
        first[i] = min(first.get(i, key), key)
    assert {tuple(r) for r in fp.duplicate_of(df).collect()} == {(i, k[2]) for i, k in first.items()}


def test_equal_fingerprints_are_one_row_of_a_block(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 7, start + dt.timedelta(seconds=i // 2)) for i in range(3000)] + [(3000, 6, start + dt.timedelta(hours=20)), (3001, 7, start + dt.timedelta(hours=30))]
    prints = spark.createDataFrame(rows, "id long, simhash long, ts timestamp_ntz")
    assert fp.near_prints(fp._rows(prints, 24), 3).count() <= 9
    assert {tuple(r) for r in fp.duplicate_of(prints).collect()} == {(i, 0) for i in range(1, 3001)} | {(3001, 3000)}


def test_writes_by_key(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, v int")
    n = spark.createDataFrame([(2, "z", 9), (3, "d", 4), (3, "c", 3), (None, "n", 0)], "k int, x string, v int")
    assert {tuple(r) for r in keyed.insert_ignore(t, n, ["k"]).collect()} == {(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0)}
    assert {tuple(r) for r in keyed.upsert(t, n.where("x in ('z', 'd')"), ["k"]).collect()} == {(1, "a", 1), (2, "z", 9), (3, "d", 4)}
    assert {tuple(r) for r in keyed.replace_window(t, n.limit(1), ["k"]).collect()} == {(1, "a", 1), (2, "z", 9)}


def test_vocabulary_files():
    files = {"tickers": {"BTC": {"aliases": ["比特币", "btc"]}, "ETH": {}}, "chains": None, "narratives": {"AI": {"keywords": ["Agents"]}}, "kols": {}}
    rows = connectors.vocabulary_rows(files.get)
    assert [r[1:4] for r in rows] == [("btc", "BTC", "ticker"), ("比特币", "BTC", "ticker"), ("eth", "ETH", "ticker"), ("ai", "AI", "narrative"), ("agents", "AI", "narrative")]
    for bad in ({"tickers": {"BTC": None}}, {"tickers": ["BTC"]}, {"tickers": {"BTC": {"aliases": "x"}}}, {"tickers": {"BTC": {}}, "chains": {"BTC": {}}}, {"tickers": {"A": {"aliases": ["x"]}, "B": {"aliases": ["x"]}}}):
        with pytest.raises(ValueError):
            connectors.vocabulary_rows(bad.get)


def test_rendering(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(render.percent(F.lit(1), F.lit(3))) == "33.3" and get(render.percent(F.lit(1), F.lit(0))) == "-"
    assert get(render.bar(F.lit(0.5), 4)) == "██" and get(render.markdown_escaped(F.lit("a_b*`["))) == r"a\_b\*\`\["
    assert get(render.digest_line(F.lit(1), F.lit("A_B"), F.lit("ticker"), F.lit(2.5), F.lit(7), F.lit(2), F.lit(True))) == r"1. `A\_B` (ticker) growth=2.5x 提及=7 跨源=2 ★"
    empty = spark.createDataFrame([], "other string, pmi double, cooccur_count long")
    assert render.hint(empty).first()["hint"] == "（暂无）"
    assert notify.fitted("x" * 10, 5) == "xx..." and notify.fitted("x", 5) == "x"
    sent = []
    broken = lambda t: 1 / 0
    assert notify.to_all([broken, lambda t: sent.append(t) or True])("hi") and sent == ["hi"] and not notify.safe(broken)("hi")


def test_streams_equal_batches(spark, tmp_path):
    rows = _prints(8, 80)
    spark.createDataFrame(rows, "id long, simhash long, ts timestamp_ntz").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "prints"))
    stream = connectors.folder_stream(spark, str(tmp_path / "prints"), "id long, simhash long, ts timestamp_ntz")
    q = dedup.near_duplicates(stream).writeStream.format("memory").queryName("near_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("near_out").collect()} == _near(rows)
    m = _mentions(spark, [(i, "AB"[i % 2], "t", NOW + dt.timedelta(minutes=i)) for i in range(60)])
    m.write.parquet(str(tmp_path / "mentions"))
    stream = connectors.folder_stream(spark, str(tmp_path / "mentions"), MENTIONS)
    q = windows.sliding_counts(stream).writeStream.format("memory").queryName("win_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["window_start", "window_end", "entity", "n", "engagement"]
    want = m.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes").alias("w"), "entity").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "entity", "n", "engagement")
    assert sorted(map(tuple, spark.table("win_out").select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_worker_isolates_failures_and_bursts_wait(spark, tmp_path):
    _mentions(spark, [(i, "A", "t", NOW) for i in range(30)]).repartition(3).write.parquet(str(tmp_path / "m"))
    seen = []
    clock = iter((0.0, 10.0, 40.0))
    burst = worker.Burst(lambda b, n: seen.append(b.count()) is None, least=15, clock=lambda: next(clock))
    w = worker.Worker({"broken": lambda b, n: 1 / 0, "burst": burst})
    stream = connectors.folder_stream(spark, str(tmp_path / "m"), MENTIONS, files_per_batch=1)
    w.start(stream, str(tmp_path / "c"), poll=None).awaitTermination(120)
    assert w.batches == 3 and w.failures == {"broken": 3} and len(seen) == 1 and burst.pending == 10


def test_the_driver_contract(spark, small):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_tables_are_created_and_dropped(spark, small, tmp_path):
    from pulsemill.sources import schemas
    from pulsemill.sources.tables import table

    spark.sql(f"create database if not exists pulse_test location '{tmp_path}/db'")
    for _ in range(2):
        schemas.create_tables(spark, "pulse_test")
    assert {t.name for t in spark.catalog.listTables("pulse_test") if not t.isTemporary} == set(schemas.SCHEMAS)
    for name in ("twitter_posts", "binance_square_posts", "discord_messages", "normalized_messages", "entity_mentions"):
        assert set(spark.table(f"pulse_test.{name}").dtypes) == set(table(spark, small, name).dtypes)
    schemas.drop_tables(spark, "pulse_test")
    assert all(set(k) <= {c.strip().split()[0].strip("`") for c in schemas.SCHEMAS[t].split(", ")} for t, k in schemas.KEYS.items())


def test_cooldown(spark):
    from pulsemill.operators import cooldown as cd

    c = cd.Cooldown()
    t = lambda **k: NOW + dt.timedelta(**k)
    for last, at, growth, cross, want in (
        (None, NOW, 25.3, 1, cd.FIRST), ((NOW, 25, 1), t(minutes=30), 25, 1, None), ((NOW, 20, 1), t(minutes=30), 40, 1, cd.ESCALATED), ((NOW, 22, 1), t(minutes=30), 23, 2, cd.WIDER),
        ((NOW, 20, 1), t(hours=6, minutes=5), 20, 1, cd.HEARTBEAT), ((NOW, 20, 1), t(minutes=75), 20, 1, cd.AGAIN),
    ):
        assert cd.decide(last, at, growth, cross, c) == want
    assert cd.decide((NOW, 20, 1), t(minutes=30), 27, 1, cd.Cooldown(step=0.3)) == cd.GROWN
    r = random.Random(2)
    rows = [(r.choice("abc"), t(minutes=r.randrange(3000)), r.random() * 9, r.randrange(3), "clash") for _ in range(200)] + [(None, NOW, 1.0, 1, ""), ("a", None, 1.0, 1, "")]
    want, last = set(), {}
    for k, at, g, x, _ in sorted(rows[:200]):
        w = cd.decide(last.get(k), at, g, x, c)
        if w:
            last[k] = (at, g, x)
            want.add((k, at, g, x, w))
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, growth double, cross int, why string")
    assert {tuple(x) for x in cd.passed(df, c).collect()} == want
    assert cd.passed(df.limit(0), c).count() == 0
