"""Trailing totals and late corrections against brute force, with the edge cases of their docstrings."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsemill.operators.late_events import FingerBTree, corrected_hours
from pulsemill.operators.rolling import NOTHING, TwoStackQueue, combine, trailing_totals

DAY = dt.datetime(2024, 1, 1)
MENTIONS = "msg_id long, entity string, ts timestamp_ntz, engagement int, n_7 string, day string"
EVENTS = "id long, raw_source string, raw_id long, ts timestamp_ntz, created_at timestamp_ntz, engagement int, arrival string"


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.one_of(st.none(), st.integers(-9, 9))), max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_queue_equals_a_plain_window(steps, width):
    q, held, day = TwoStackQueue(), [], 0
    for gap, n, top in steps:
        day += gap
        q.push(day, (n, n, top))
        held.append((day, (n, n, top)))
        q.evict(day - width + 1)
        want = NOTHING
        for d, v in held:
            if d > day - width:
                want = combine(want, v)
        assert q.total() == want


def _brute(rows, periods):
    once = {}
    for k, (m, e, t, v) in enumerate(rows):
        if e is None or t is None:
            continue
        key = (e, m) if m is not None else (e, None, k)
        d, w = once.get(key, (t.date(), None))
        once[key] = (min(d, t.date()), v if w is None else w if v is None else max(v, w))
    days = [t.date() for _, _, t, _ in rows if t is not None]
    out = {}
    for e in {k[0] for k in once}:
        d = min(days)
        while d <= max(days):
            row = []
            for p in periods:
                inside = [v for k, (x, v) in once.items() if k[0] == e and d - dt.timedelta(p) < x <= d]
                vs = [v for v in inside if v is not None]
                row += [len(inside), sum(vs), max(vs) if vs else None, len(inside) / p]
            out[e, d] = row
            d += dt.timedelta(1)
    return out


@pytest.mark.parametrize("quiet", [True, False])
def test_trailing_totals(spark, quiet):
    r = random.Random(7)
    rows = [(r.choice([None, *range(40)]), r.choice(["a", "b", "c", None]), r.choice([None, *(DAY + dt.timedelta(hours=r.randrange(24 * 50)) for _ in range(9))]), r.choice([None, r.randrange(50)])) for _ in range(150)]
    rows += rows[:10]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], MENTIONS)
    got = {(x["entity"], x["day"]): [x[c] for p in (3, 10) for c in (f"n_{p}", f"sum_{p}", f"max_{p}", f"avg_{p}")] for x in trailing_totals(df, (10, 3), quiet=quiet).collect()}
    want = {k: v for k, v in _brute(rows, (3, 10)).items() if quiet or v[4]}
    assert got == want


def test_trailing_totals_of_nothing(spark):
    assert trailing_totals(spark.createDataFrame([], MENTIONS)).count() == 0
    assert trailing_totals(spark.createDataFrame([(1, None, DAY, 1, "", ""), (1, "a", None, 1, "", "")], MENTIONS)).count() == 0
    with pytest.raises(ValueError):
        trailing_totals(spark.createDataFrame([], MENTIONS), (0,))


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 3), st.booleans()), max_size=250))
@settings(max_examples=60, deadline=None)
def test_finger_tree_equals_a_dictionary(steps):
    tree, held = FingerBTree(4), {}
    for period, n, cut in steps:
        if cut:
            tree.evict(period)
            held = {k: v for k, v in held.items() if k >= period}
        else:
            had = held.get(period, (0, 0))
            held[period] = (had[0] + n, had[1] + 2 * n)
            assert tree.add(period, n, 2 * n) == held[period]
        assert len(tree) == len(held)
        assert tree.total() == (sum(v[0] for v in held.values()), sum(v[1] for v in held.values()))
        assert tree.since(period)[0] == sum(v[0] for k, v in held.items() if k >= period)


def test_corrections(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        ts = DAY + dt.timedelta(minutes=r.randrange(60 * 24 * 12))
        late = dt.timedelta(minutes=r.choice([-30, 1, 50, 200, 1500, 3000]))
        rows.append((i, r.choice(["x", "y", None]), r.choice([None, *range(300)]), ts, ts + late, r.choice([None, 5])))
    rows += [(900, "x", 1, None, DAY, 1), (901, "x", 2, DAY, None, 1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], EVENTS)
    hour = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
    first = {}
    for i, s, k, ts, at, v in rows:
        if ts is not None and at is not None:
            key = (s, k) if k is not None else (s, None, i)
            first[key] = min(first.get(key, (at, ts, v or 0)), (at, ts, v or 0))
    added = {}
    for key, (at, ts, v) in first.items():
        if at < dt.datetime(1970, 1, 1) + dt.timedelta(hours=hour(ts) + 25):
            n, t = added.get((key[0], hour(ts), hour(at)), (0, 0))
            added[key[0], hour(ts), hour(at)] = (n + 1, t + v)
    want = set()
    for (s, p, a), (n, _) in added.items():
        so_far = [v for (s2, p2, a2), v in added.items() if (s2, p2) == (s, p) and a2 <= a]
        want.add((s, p, a, n, sum(x[0] for x in so_far), sum(x[1] for x in so_far)))
    for block in (24 * 7, 5):
        assert {tuple(x) for x in corrected_hours(df, block_hours=block).collect()} == want
    assert corrected_hours(spark.createDataFrame([], EVENTS)).count() == 0
