"""Stateful alerts on streams: equal to the batch, told once, and whole after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.tables import last_before
from plumbline.plans import streams as P
from plumbline.shared import fresh_path
from plumbline.streaming import monitor as M
from plumbline.streaming import sketches as SK
from plumbline.streaming import stateful as S

SCHEMA = "k string, ts timestamp, v double"
RUNS = "k string, state string, since long, until long, windows long"
GAPS = "k string, state string, since long, windows long"


def stamp(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame([(k, stamp(t), float(v)) for k, t, v in rows], SCHEMA)


class Feed:
    """A folder that rows are sent to, read by a stream that stops and starts again."""

    def __init__(self, spark, alerts, schema):
        self.spark, self.alerts, self.schema = spark, alerts, schema
        self.folder, self.out, self.mark = (fresh_path(spark, n) for n in ("feed", "told", "mark"))

    def send(self, rows, end=False):
        df = frame(self.spark, rows)
        df.coalesce(1).write.mode("append").parquet(self.folder)
        if end:
            P.close(df, self.folder)
        with S.state_store(self.spark):
            M.replay(self.alerts(P.live(df, self.folder)), self.out, self.mark)
        return self.told()

    def told(self):
        return sorted(tuple(r) for r in self.spark.read.schema(self.schema).parquet(self.out).filter("k is not null").collect())


BASE = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def test_sustained_restarts_in_mid_breach(spark):
    """Windows of 60 s, held for 180; the stream stops twice while a run lasts."""
    minute = lambda k, bad: [("a", 60 * k + s, 9 if bad else 1) for s in (5, 50)]
    bad = [0, 1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1, None, 1, 1, 1, 1]
    rows = [minute(k, x) for k, x in enumerate(bad) if x is not None]
    rows = [r for some in rows for r in some]
    feed = Feed(spark, lambda s: S.sustained_stream(s, {"m": F.avg("v")}, F.col("m") > 5, 60, 180, ["k"]), RUNS)
    feed.send(rows[:6])
    feed.send(rows[6:7] + [("b", 700, 1)])
    # rows that come late, but not too late, are in their windows
    got = feed.send(rows[7:][::-1], end=True)
    batch = M.sustained(M.windowed(frame(spark, rows), 60, {"m": F.avg("v")}, ["k"]), F.col("m") > 5, 60, 180, ["k"])
    want = sorted((r.k, r.since, r.until, r.windows) for r in batch.collect())
    shown = lambda t: str(dt.datetime.fromtimestamp(t, dt.timezone.utc))[:19]
    assert sorted((k, shown(a), shown(b), n) for k, state, a, b, n in got if state == "ended") == want and len(want) == 3
    # each run fires once, when it has lasted three windows
    assert [(k, a, n) for k, state, a, b, n in got if state == "firing"] == [("a", BASE + 60 * k, 3) for k in (1, 9, 13)]


def test_absence_is_told_once_and_again_when_it_ends(spark):
    rows = [("a", 0), ("b", 0), ("a", 100), ("b", 3000), ("a", 4000), ("a", 9000)]
    feed = Feed(spark, lambda s: S.absence_stream(s, 300, 1800, ["k"], BASE - 3000), GAPS)
    first = feed.send([(k, t, 0) for k, t in rows[:4]])
    feed.send([(k, t, 0) for k, t in rows[4:5]])
    feed.send([(k, t, 0) for k, t in rows[5:]])
    got = feed.send([("c", 9100, 0)], end=True)
    got = [r for r in got if r[0] != "c"]
    assert set(first) <= set(got) and len(got) == len(set(got))
    returned = sorted((k, since - BASE, n) for k, state, since, n in got if state == "returned")
    absent = sorted((k, since - BASE) for k, state, since, n in got if state == "absent")
    # the time before the first row, then gaps of whole windows
    assert returned == [("a", -3000, 10), ("a", 300, 12), ("a", 4200, 16), ("b", -3000, 10), ("b", 300, 9)]
    assert absent == [("a", 300), ("a", 4200), ("a", 9300), ("b", 300), ("b", 3300)]


def test_sessions_merge_over_arrivals(spark):
    rows = [("a", 0), ("a", 29), ("a", 100), ("a", 125), ("a", 150), ("b", 10), ("b", 50), ("b", 95)]
    df = frame(spark, [(k, t, 0) for k, t in rows])
    got = sorted((r.k, r.n) for r in S.sessions(df, "30 seconds", 1, ["k"]).collect())
    assert got == [("a", 2), ("a", 3), ("b", 1), ("b", 1), ("b", 1)]
    feed = Feed(spark, lambda s: S.sessions(s, "30 seconds", 3, ["k"]), "k string, since timestamp, until timestamp, n long")
    feed.send([(k, t, 0) for k, t in rows if t in (0, 100, 150, 10, 50)])
    (one,) = feed.send([(k, t, 0) for k, t in rows if t not in (0, 100, 150, 10, 50)], end=True)
    assert one[0] == "a" and one[3] == 3 and (one[2] - one[1]).seconds == 50


def test_late_rows_are_counted_by_batch(spark):
    told = S.LateRows()
    folder, out, mark = (fresh_path(spark, n) for n in ("late", "kept", "mark"))
    sent = [[0, 1000, 5000], [4390, 4400, 4401, 9000], [1, 2, 3, 8401, 8400], [8402]]
    for k, times in enumerate(sent):
        df = spark.createDataFrame([(100 * k + i, stamp(t)) for i, t in enumerate(times)], "id long, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(folder)
        M.replay(S.once(P.live(df, folder), "id"), out, mark, listener=told)
    got = [(r.input_rows, r.dropped) for r in told.table(spark).filter("input_rows > 0").orderBy("batch").collect()]
    assert got == [(3, 0), (4, 2), (5, 4), (1, 0)]
    assert spark.read.parquet(out).count() == 13 - 6
    assert told.table(spark).filter("query is null").count() == 0


def test_late_rows_keep_the_last_batches():
    class Progress:
        id, name, numInputRows, stateOperators, eventTime = "q", None, 1, [], {}

    told = S.LateRows(most=2)
    for batch in (0, 1, 1, 2):
        p = Progress()
        p.batchId = batch
        told.add(p)
    assert [r[2] for r in told.rows.values()] == [1, 2]


@pytest.mark.parametrize("alerts,schema", [
    (lambda s: S.sustained_stream(s, {"m": F.avg("v")}, F.col("m") > 5, 60, 180, ["k"]), RUNS), (lambda s: S.absence_stream(s, 300, 1800, ["k"]), GAPS),
])
def test_nothing_comes(spark, alerts, schema):
    df = spark.createDataFrame([], SCHEMA)
    assert P.replayed(df, alerts, schema).filter("k is not null").count() == 0


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(S.STORE[0])
    with pytest.raises(ValueError), S.state_store(spark):
        raise ValueError
    assert spark.conf.get(S.STORE[0]) == before


def brute_last(left, right):
    out = []
    for k, t, i in left:
        known = [(u, v) for j, u, v in right if j == k and u is not None and t is not None and u <= t]
        out.append((i, max(known)[1] if known else None))
    return sorted(out)


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_last_before(spark, ranges):
    """Keys in many ranges, null keys and times, ties, repeated rows, clashing columns."""
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(300)]
    right = [(key(), rng.choice([None, *range(0, 60, 3)]), rng.randrange(50)) for _ in range(60)]
    right += right[:5]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        a = spark.createDataFrame([(*r, "clash", 1) for r in left], "k string, t int, i int, v string, _range int")
        b = spark.createDataFrame(right, "k string, t int, v int")
        got = last_before(a, b, "t", ["k"], ["v"])
        assert got.columns == ["k", "t", "i", "_range", "v"]
        assert sorted((r.i, r.v) for r in got.collect()) == brute_last(left, right)
        assert last_before(a, b.filter("false"), "t", ["k"], ["v"]).filter("v is null").count() == 300
        assert last_before(a.filter("false"), b, "t", ["k"], ["v"]).count() == 0
        alone = last_before(a, b, "t", [], ["v"])
        assert sorted((r.i, r.v) for r in alone.collect()) == brute_last([(0, t, i) for _, t, i in left], [(0, t, v) for _, t, v in right])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cool_down_by_history_and_by_decisions(spark):
    """Several retrainings: of the history, and those that runs ask for; days are whole ones."""
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    runs = [
        ("m", day(0), None, "none"), ("m", day(1), None, "full"), ("m", day(7, 23), None, "model_only"), ("m", day(8), None, "full"), ("m", day(9), day(8, 12), "none"),
        ("m", day(15, 11), day(8, 12), "model_only"), ("m", day(15, 12), day(8, 12), "model_only"), ("m", day(16), day(3), "full"), ("n", day(2), day(1), "full"), ("n", day(9), day(1), "full"), (None, day(3), None, "full"),
    ]
    df = spark.createDataFrame(runs[::-1], "model string, run timestamp, last timestamp, wanted string")
    got = sorted((r.model or "", r.run, r.strategy, r.blocked, r.needs_retraining, r.days_since) for r in M.cool_down(df, "run", "last", ["model"]).collect())
    assert got == [
        ("", day(3), "full", False, True, None),
        ("m", day(0), "none", False, False, None), ("m", day(1), "full", False, True, None), ("m", day(7, 23), "none", True, False, 6), ("m", day(8), "full", False, True, 7), ("m", day(9), "none", False, False, 0),
        ("m", day(15, 11), "none", True, False, 6), ("m", day(15, 12), "model_only", False, True, 7), ("m", day(16), "none", True, False, 0),
        ("n", day(2), "none", True, False, 1), ("n", day(9), "full", False, True, 8),
    ]
    assert M.cool_down(df.filter("false"), "run", "last", []).count() == 0


def test_sketches_merge(spark):
    """Days from hours from minutes are within the bound of the rows, as the sketch of all rows is; nulls have no place."""
    rand = random.Random(5)
    rows = [(stamp((i * 7919) % 86400), None if i % 11 == 0 else rand.random() ** 4 * 100, i % 3 or None) for i in range(60_000)]
    log = spark.createDataFrame(rows, "ts timestamp, v double, k int")
    minutes = SK.sketches(log, "v", 60, ["k"])
    hours = SK.rolled(minutes, 3600, ["k"])
    days = SK.rolled(hours, 86400, ["k"])
    whole = SK.sketches(log, "v", 86400, ["k"])
    for p in (0.01, 0.5, 0.95, 0.999):
        for w in (days, whole):
            got = SK.off(w, log, "v", 86400, p, ["k"]).collect()
            assert len(got) == 3 and all(r.error <= 0.01 for r in got)
    assert {r.k: r.n for r in days.collect()} == {r.k: r["count"] for r in log.filter("v is not null").groupBy("k").count().collect()}
    # a window of fewer values than the sketch holds is exact
    few = spark.createDataFrame(rows[:300], log.schema)
    assert all(r.error <= 1 / 250 for r in SK.off(SK.sketches(few, "v", 86400), few, "v", 86400, 0.5).collect())
    assert SK.sketches(log.filter("false"), "v", 60).count() == 0


def test_absence_tells_rows_and_knows_its_timer():
    """A key takes and tells rows, and deletes its one timer without a search."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    did, a = [], S.Absence(["k"], 300, 1800, None)
    a.handle = SimpleNamespace(deleteTimer=lambda t: did.append(("delete", t)), registerTimer=lambda t: did.append(("register", t)))
    a.state = SimpleNamespace(exists=lambda: True, get=lambda: (0,), update=lambda v: did.append(v))
    assert list(a.handleInputRows(("x",), iter([Row(k="x", t=3300), Row(k="x", t=3000)]), None)) == [Row(k="x", state="returned", since=300, windows=9)]
    assert did == [("delete", 2_100_000), (3300,), ("register", 5_400_000)]
