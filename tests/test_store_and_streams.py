"""Durable keyed tables, the composed steps, stateful streams, and every registered query once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import cooccurrence, cooldown, extract, ingest, late_events, normalize, render
from pulsemill.sources import connectors, notify
from pulsemill.sources.keyed_table import KeyedTable
from pulsemill.streaming import cooldown as cooling
from pulsemill.streaming import dedup, late, worker

NOW = dt.datetime(2024, 5, 1, 12, 0)
POSTS = "raw_source string, raw_id long, content string, author string, ts timestamp_ntz, created_at timestamp_ntz"


def test_keyed_table_outlives_its_session_and_touches_only_its_parts(spark, tmp_path):
    schema, at = "k int, d string, v int", f"{tmp_path}/table"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    t = KeyedTable(spark, at, schema, ["k", "d"], by="d")
    assert t.read().count() == 0
    for _ in range(2):
        t.insert_ignore(rows((1, "a", 1), (2, "b", 2), (2, "b", 3), (None, "c", 0)))
    assert sorted(map(str, t.read().collect())) == sorted(map(str, rows((1, "a", 1), (2, "b", 2), (None, "c", 0), (None, "c", 0)).collect()))
    t.upsert(rows((1, "a", 9)))
    t = KeyedTable(spark, at, schema, ["k", "d"], by="d")
    assert t._manifest()["parts"] == {"a": 3, "b": 2, "c": 2}
    assert {r["v"] for r in t.read().where("k is not null").collect()} == {9, 2}
    t.vacuum()
    assert t.read().count() == 4 and not (tmp_path / "table" / "v1" / "_part=a").exists()
    t.upsert(rows())
    assert t._manifest()["version"] == 3


def test_ingest_and_extract_twice(spark, tmp_path):
    store = ingest.Store.at(spark, f"{tmp_path}/store", parts=3)
    assert ingest.ingest(store, spark.createDataFrame([], POSTS)) == 0
    text = "the quick brown fox jumps over the lazy dog and buys $PEPE again today"
    posts = [("twitter", 1, f"  {text} ", "Ann", NOW, NOW), ("discord", 1, text + "!", None, NOW + dt.timedelta(hours=2), NOW), ("twitter", 2, " ", "x", NOW, NOW), ("twitter", 3, "something else about BTC 42", "kol one", NOW, NOW)]
    frame = spark.createDataFrame(posts, POSTS)
    assert [ingest.ingest(store, frame) for _ in range(2)] == [3, 0]
    late_copy = spark.createDataFrame([("discord", 9, text, "bob", NOW + dt.timedelta(hours=20), NOW), ("discord", 10, text, "bob", NOW + dt.timedelta(hours=60), NOW)], POSTS)
    assert ingest.ingest(store, late_copy) == 2  # held against what the store has
    got = {(r["raw_source"], r["raw_id"]): (r["text"], r["is_duplicate"], r["dup_of"]) for r in store.messages.read().collect()}
    first = next(r["id"] for r in store.messages.read().collect() if (r["raw_source"], r["raw_id"]) == ("twitter", 1))
    assert got[("twitter", 1)] == (text, False, None) and got[("discord", 1)][1:] == (True, first) and got[("discord", 9)][1:] == (True, first)
    assert got[("discord", 10)][1:] == (False, None) and len(got) == 5
    vocab = extract.Vocabulary((("btc", "BTC", "ticker"),))
    kols = spark.createDataFrame([("KOL One",)], "name string")
    assert [ingest.extract(store, vocab, NOW, kols) for _ in range(2)] == [3, 0]
    assert {(r["entity"], r["raw_source"], r["is_kol_mention"]) for r in store.mentions.read().collect()} == {("PEPE", "twitter", False), ("PEPE", "discord", False), ("BTC", "twitter", True)}
    assert store.messages.read().where("l1_processed_at is null").count() == 2  # the duplicates


def test_no_kol_name_is_cut_off(spark):
    messages = spark.createDataFrame([(1, "twitter", "hello $PEPE", "name 20000", NOW, 1, 1.0, False)], "id long, raw_source string, text string, author string, ts timestamp_ntz, engagement int, author_weight double, is_duplicate boolean")
    names = spark.range(20_001).select(F.concat(F.lit("Name "), "id").alias("name"))
    assert extract.mention_rows(messages, extract.Vocabulary(()), names).first()["is_kol_mention"]


def test_all_entities_of_a_message_on_request(spark):
    rows = spark.createDataFrame([(1, f"e{i:02d}") for i in range(15)], "msg_id long, entity string")
    assert cooccurrence.capped(rows, 10).count() == 10 and cooccurrence.capped(rows, None).count() == 15


def test_cooldown_after_growth_of_none(spark):
    c = cooldown.Cooldown(step=0.2)
    last = (NOW, 0.0, 1)
    assert cooldown.decide(last, NOW + dt.timedelta(minutes=30), 5.0, 1, c) is None
    one = spark.range(1).select(cooldown.decided(F.lit(NOW), F.lit(0.0), F.lit(1), F.lit(NOW + dt.timedelta(minutes=30)), F.lit(5.0), F.lit(1), c).alias("why"))
    assert one.first()["why"] is None


def test_rendered_blocks_and_times(spark):
    lines = spark.createDataFrame([(1, "b"), (2, "a")], "k int, line string")
    assert render.evidence_block(lines, [F.desc("k")]).first()["block"] == "a\n\nb"
    assert render.evidence_block(lines.limit(0), [F.desc("k")]).first()["block"] == ""
    got = spark.range(1).select(render.local_time(F.lit(NOW), "Asia/Shanghai"), render.local_time(F.lit(NOW), "Asia/Shanghai", True)).first()
    assert tuple(got) == ("2024-05-01 20:00", "20:00")
    line = spark.range(1).select(render.digest_line(F.lit(1), F.lit("X"), F.lit(None).cast("string"), F.lit(1.0), F.lit(1), F.lit(1), F.lit(False))).first()[0]
    assert line == "1. `X` (n/a) growth=1.0x 提及=1 跨源=1"
    names = spark.createDataFrame([("A", "ticker"), ("A", "chain"), ("B", "kol"), (None, "kol")], "name string, entity_type string")
    assert [tuple(r) for r in extract.name_conflicts(names).collect()] == [("A", ["chain", "ticker"])]


def _run(stream, name, at, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return [tuple(r) for r in stream.sparkSession.table(name).collect()]


def test_cooldown_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = sorted(((r.choice("abc"), NOW + dt.timedelta(minutes=7 * i), r.choice((0.0, 1.0, 3.0, 9.0)), r.randrange(3)) for i in range(90)), key=lambda x: x[1])
    schema = "key string, at timestamp_ntz, growth double, cross int"
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "signals"))
    c = cooldown.Cooldown(quiet=dt.timedelta(hours=1), step=0.2)
    stream = connectors.folder_stream(spark, str(tmp_path / "signals"), schema, files_per_batch=1)
    got = _run(cooling.passed(stream, c, lateness="10 days"), "cool_out", tmp_path / "c")
    assert len(got) > 10 and set(got) == {tuple(x) for x in cooldown.passed(spark.createDataFrame(rows, schema), c).collect()}


def test_late_stream_ends_with_the_batch_figures(spark, tmp_path):
    r = random.Random(8)
    schema = "raw_source string, raw_id long, ts timestamp_ntz, created_at timestamp_ntz, engagement int"
    rows = []
    for i in range(200):
        t = NOW + dt.timedelta(minutes=r.randrange(4000))
        rows.append((r.choice("ab"), i, t, t + dt.timedelta(minutes=r.choice((1, 90, 600, 3000))), r.randrange(9)))
    events = spark.createDataFrame(rows, schema)
    events.orderBy("created_at").coalesce(1).write.parquet(str(tmp_path / "events"))
    got = _run(late.corrected_hours(connectors.folder_stream(spark, str(tmp_path / "events"), schema)), "late_out", tmp_path / "l")
    assert sorted(got) == sorted(map(tuple, late_events.corrected_hours(events).collect()))


def test_trailing_totals_at_arrival(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        t = NOW + dt.timedelta(minutes=r.randrange(6000))
        rows.append((r.choice(("a", "b", None)), i, t, t + dt.timedelta(minutes=r.choice((-70, 1, 90, 600, 3000))), r.randrange(9)))
    rows += [("a", 1000, None, NOW, 1), ("a", 1001, NOW, None, 1)]
    events = spark.createDataFrame([(*x, "clash") for x in rows], "raw_source string, raw_id long, ts timestamp_ntz, created_at timestamp_ntz, engagement int, period string")
    hour = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    held = [(s, hour(t), hour(a), v) for s, _, t, a, v in rows if t and a and hour(a) <= hour(t) + 24]
    want = set()
    for s, a in {(s, a) for s, _, a, _ in held}:
        part = [v for x, p, y, v in held if x == s and y <= a and a - 6 < p <= a]
        want.add((s, a, len(part), sum(part)))
    assert {tuple(x) for x in late_events.trailing_at_arrival(events, 6).collect()} == want
    assert late_events.trailing_at_arrival(events.limit(0)).count() == 0
    with pytest.raises(ValueError):
        late_events.trailing_at_arrival(events, 26)


def test_state_of_the_duplicate_stream_ends(spark, tmp_path):
    schema = "id long, simhash long, ts timestamp_ntz"
    parts = [[(1, 7, NOW), (2, 7, NOW + dt.timedelta(hours=1))], [(3, 1 << 40, NOW + dt.timedelta(days=9))], [(4, 7, NOW + dt.timedelta(days=18)), (5, 6, NOW + dt.timedelta(days=18, hours=3))], [(6, 1 << 50, NOW + dt.timedelta(days=40))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={i}"))
    stream = spark.readStream.schema(schema + ", d int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = dedup.near_duplicates(stream).writeStream.format("memory").queryName("ends_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    found = {tuple(sorted(r[:2])) for r in spark.table("ends_out").collect()}
    assert found == {(1, 2), (4, 5)}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert rows[-1] <= 16  # what is left is of the last prints


def test_quarter_gate_survives_a_restart(spark, tmp_path):
    done = []
    gate = worker.QuarterGate(spark, f"{tmp_path}/gate", lambda end: done.append(end) is None)
    assert gate(NOW + dt.timedelta(minutes=7)) and not gate(NOW + dt.timedelta(minutes=14))
    again = worker.QuarterGate(spark, f"{tmp_path}/gate", lambda end: False)
    assert not again(NOW) and again.last() == NOW and not again(NOW + dt.timedelta(minutes=15)) and again.last() == NOW
    with pytest.raises(ZeroDivisionError):
        worker.QuarterGate(spark, f"{tmp_path}/gate", lambda end: 1 / 0, always=True)(NOW + dt.timedelta(minutes=30))
    assert again.last() == NOW + dt.timedelta(minutes=30)


def test_jdbc_round_trip(spark, tmp_path):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database driver")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connectors.write_jdbc(spark.range(100).selectExpr("id", "cast(id as string) as name"), url, "things", parts=2)
    rows = connectors.jdbc_table(spark, url, "things", "id", (0, 100), 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100 and rows.where("id >= 50").count() == 50


def test_templates_and_log_files(tmp_path):
    (tmp_path / "t.txt").write_text("{entity}：{n} 条", encoding="utf-8")
    assert render.filled(str(tmp_path / "t.txt"), entity="BTC", n=2) == "BTC：2 条"
    for _ in range(2):
        handlers = notify.log_to(str(tmp_path / "log"))
    notify.safe(lambda text: 1 / 0)("x")
    assert len(handlers) == 2 and (tmp_path / "log").read_text().count("a message was not sent") == 1
    for handler in handlers:
        handler.close()
        notify.logging.getLogger("pulsemill").removeHandler(handler)


def test_every_query_runs(spark, small):
    import __spark_entry__ as entry

    failed = {}
    for name, query in entry.queries().items():
        try:
            query(spark, small).write.format("noop").mode("overwrite").save()
        except Exception as e:
            failed[name] = str(e)[:300]
    assert not failed
