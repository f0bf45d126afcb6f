import random

from pyspark.sql import functions as F

from loomstead.functions.columns import local_day
from loomstead.operators import timeline as T

MINUTE = 60_000


def test_local_day_depends_on_the_zone(spark):
    ms = 1783195200000  # 2026-07-04 20:00 UTC
    row = spark.range(1).select(local_day(F.lit(ms), "Asia/Shanghai").alias("a"), local_day(F.lit(ms), "UTC").alias("b")).first()
    assert (row.a, row.b) == ("2026-07-05", "2026-07-04")


def test_gap_and_clock_restart(spark):
    rows = [("d", "b1", 0, i, 1_000_000 + i, 1_000_000_000) for i in range(3)] + [("d", "b2", 1, i, 1_000_000 + 20 * MINUTE + i, 500_000_000) for i in range(3)]
    df = spark.createDataFrame(rows, "device string, batch string, batch_order int, i int, wall bigint, base bigint")
    out = T.clock_gaps(df, "device", ["batch_order", "i"], "wall", 10 * MINUTE, "base", "batch").orderBy("batch_order", "i").collect()
    assert [r.time_gap for r in out] == [False, False, False, True, False, False]
    assert [r.clock_backward for r in out] == [False, False, False, True, False, False]
    assert out[0].wall_gap_ms == 0


def test_sessions_by_row_loop(spark):
    rng = random.Random(5)
    rows = []
    for d in "ab":
        day = 0
        for i in range(60):
            day += rng.choice([0, 0, 0, 1, -1])
            rows.append((d, i, f"day{day}", rng.choice(["x", "x", "y"]), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "device string, i int, day string, app string, gap boolean")
    got = {(r.device, r.i): r.session_id for r in T.sessionize(df, "device", ["i"], "day", ["app", F.col("gap")]).collect()}
    want, before, seg = {}, None, 0
    for r in rows:
        if before is None or before[0] != r[0] or before[2] != r[2]:
            seg = 0
        elif before[3] != r[3] or r[4]:
            seg += 1
        want[r[0], r[1]] = f"{r[0]}:{r[2]}:{seg}"
        before = r
    assert got == want


def test_four_full_windows(spark):
    df = spark.range(750).select(F.lit("s").alias("session_id"), (F.col("id") * 10).alias("rel"))
    out = T.sliding_windows(df, 5000, 1000)
    assert out.select("window_index").distinct().count() == 4
    assert out.groupBy("window_index").count().agg(F.min("count")).first()[0] >= 350


def test_windows_by_loop(spark):
    rng = random.Random(7)
    rows = [(f"s{s}", rng.randrange(0, 20_000)) for s in range(6) for _ in range(12)]
    size, stride = 5000, 1700
    got = {(r.session_id, r.rel, r.k) for r in T.sliding_windows(spark.createDataFrame(rows, "session_id string, rel bigint"), size, stride).collect()}
    want = set()
    for s in {r[0] for r in rows}:
        at = [r[1] for r in rows if r[0] == s]
        k = 0
        while k * stride + size <= max(at) + stride:
            want |= {(s, t, k) for t in at if k * stride <= t < k * stride + size}
            k += 1
    assert got == want


def test_short_session_is_dropped_only_below_the_bound(spark):
    df = spark.createDataFrame([("a", 0), ("a", 4990), ("b", 0), ("b", 5000)], "session_id string, wall bigint")
    assert {r.session_id for r in T.drop_short_sessions(df, "wall", 5.0).collect()} == {"b"}
    assert T.drop_short_sessions(df, "wall", 0).count() == 4


def test_session_axis_lays_batches_end_to_end(spark):
    df = spark.createDataFrame([("s", 0, 100), ("s", 0, 150), ("s", 1, 7), ("s", 1, 27), ("s", 2, 5)], "session_id string, batch_order int, ts bigint")
    assert [r.rel for r in T.session_axis(df, "ts", 10).orderBy("batch_order", "ts").collect()] == [0, 50, 60, 80, 90]


def test_range_attach_is_half_open(spark):
    w = spark.createDataFrame([("d", 0, 10), ("d", 10, 25)], "device string, start bigint, end bigint")
    e = spark.createDataFrame([("d", 0), ("d", 9), ("d", 10), ("d", 25), ("x", 5)], "device string, at bigint")
    out = T.range_attach(w, e, ["device"], "start", "end", "at", 7)
    assert sorted((r.start, r.at) for r in out.collect()) == [(0, 0), (0, 9), (10, 10)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "session_id string, rel bigint")
    assert T.sliding_windows(df, 10, 5).count() == 0


def test_successor_golden(spark):
    rows = [(i, "AB"[i // 3]) for i in range(6)]
    out = T.successor(spark.createDataFrame(rows, "i bigint, s string"), ["s"], ["i"], "i").orderBy("i").collect()
    assert [-1 if r.next_row is None else r.next_row for r in out] == [1, 2, -1, 4, 5, -1]
