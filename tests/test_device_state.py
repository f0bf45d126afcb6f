"""Keyed device state: any split of a stream of batches gives the windows of the batch plan, and closed state goes."""

import json

import pytest
from pyspark.sql import functions as F

from loomstead.plans import sensor_windows as S
from loomstead.sources.batches import BATCH
from loomstead.sources.synthetic import synthetic_batches
from loomstead.streaming.device_state import live_session_windows, window_samples

ZONE = "Asia/Shanghai"


def sample(wall, nanos, kind="ACCELEROMETER", x=0.5):
    return {"sensor_type": kind, "timestamp_elapsed_nanos": nanos, "wall_time_estimated_millis": wall, "x": x, "y": 0.0, "z": 9.8, "accuracy": 3}


def odd_batch(device, number, wall, nanos, app="app.one", uploaded="u", seconds=6, base=None, step_ms=100):
    """A batch that breaks sessions in one of the ways that batches do."""
    return {
        "device_id": device, "batch_id": f"b{number}", "session_id": uploaded, "app_package_name": app, "started_at_wall_millis": wall, "base_elapsed_nanos": nanos if base is None else base,
        "sensor_samples": [sample(wall + j * step_ms, nanos + j * step_ms * 1_000_000, "ACCELEROMETER" if j % 3 else "GYROSCOPE", j / 7) for j in range(seconds * 1000 // step_ms)],
    }


def odd_batches():
    t, n = 1_710_000_000_000, 10**12
    midnight = 1_710_086_400_000 - 8 * 3_600_000  # in the zone of the plan
    return [
        odd_batch("d1", 1, t, n), odd_batch("d1", 2, t + 6_050, n + 6_050_000_000), odd_batch("d1", 3, t + 12_100, n + 12_100_000_000, app="app.two"),
        odd_batch("d1", 4, t + 18_200, n + 18_200_000_000, app="app.two", uploaded="v"), odd_batch("d1", 5, t + 25_000, 10**9),  # the clock's base goes back
        odd_batch("d1", 6, t + 900_000, 10**9 + 900_000_000_000), odd_batch("d1", 7, t + 906_000, 10**9 + 906_000_000_000, seconds=2),
        odd_batch("d2", 8, midnight - 3_000, n, seconds=9), odd_batch("d2", 9, midnight + 6_100, n + 9_100_000_000),  # over midnight within a batch
        odd_batch("d3", 10, t, n, seconds=2), odd_batch("d4", 11, t, n, seconds=20, step_ms=1_500), odd_batch("d5", 12, t, n, seconds=1300, step_ms=650_000) | {"base_elapsed_nanos": None},
        odd_batch("d6", 13, t, n, seconds=3), odd_batch("d6", 14, t + 3_000, n + 3_000_000_000, seconds=3) | {"sensor_samples": []}, odd_batch("d6", 15, t + 6_000, n + 6_000_000_000),
    ]


def streamed(spark, folder, batches, parts, **options):
    """The windows that a stream of the batches in these parts gives, with two late beacons that fire all timers."""
    (folder / "in").mkdir(parents=True)
    far = max(b["started_at_wall_millis"] for b in batches)
    beacons = [[odd_batch("beacon", 900 + i, far + (i + 1) * 30 * 86_400_000, 10**14 + i, seconds=1)] for i in range(3)]
    for i, part in enumerate([*parts, *beacons]):
        path = folder / "in" / f"{i:03d}.json"
        path.write_text("".join(json.dumps(b) + "\n" for b in part))
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = live_session_windows(stream, zone=ZONE, **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination(280)
    return spark.read.parquet(str(folder / "out")).where("device_id <> 'beacon'"), query


COLUMNS = ["device_id", "session_id", "window_index", "k", "sensor_type", "timestamp_elapsed_nanos", "pos", "wall", "rel", "x", "y", "z"]


def planned(spark, batches, **options):
    frame = spark.read.schema(BATCH).json(spark.sparkContext.parallelize([json.dumps(b) for b in batches], 2))
    return S.windowed_samples(frame, zone=ZONE, **options)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("split", ["one", "each", "mixed"])
def test_any_split_gives_the_batch_plan(spark, tmp_path, split):
    batches = odd_batches()
    parts = {"one": [batches], "each": [[b] for b in batches], "mixed": [batches[1::2], batches[0::2]]}[split]
    out, query = streamed(spark, tmp_path, batches, parts, late="2 days")
    want = rows(planned(spark, batches))
    assert rows(window_samples(out)) == want and len(want) > 300
    base = out.select("session_id", "window_index", "n_samples", "n_batches", "start_wall", "end_wall")
    table = planned(spark, batches).groupBy("session_id", "window_index").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("batch_id").alias("n_batches"), F.min("wall").alias("start_wall"), (F.max("wall") + 1).alias("end_wall"))
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, table.collect()))
    # nothing of the closed sessions is left: of the beacons' device one session and its clock at most
    left = query.lastProgress.stateOperators[0].customMetrics if query.lastProgress else {}
    assert out.where("clock_backward").select("session_id").distinct().count() == 1
    state = {n: spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", n).load() for n in ("session", "clock")}
    assert {n: state[n].select("key.device_id").distinct().where("device_id <> 'beacon'").count() for n in state} == {"session": 0, "clock": 0}, left


def test_features_of_the_stream(spark, tmp_path):
    """The imu features of streamed windows are those of the batch plan, on generated captures of several devices."""
    frame = synthetic_batches(spark, users=2, days=1, sessions=2, batches=3)
    batches = [json.loads(r.raw) for r in frame.select("raw").collect()]
    batches.sort(key=lambda b: (b["batch_id"]))
    out, _ = streamed(spark, tmp_path, batches, [batches[:5], batches[5:]], late="3 hours")
    live, plan = window_samples(out), planned(spark, batches)
    assert rows(live) == rows(plan)
    names = ["session_id", "window_index", "acc_x_mean", "acc_z_std", "gyro_y_zcr", "corr_acc_gyro", "motion_energy_low", "acc_x_domfreq"]
    a, b = (sorted(map(tuple, S.imu_features(d).select(*[F.round(n, 9) if n not in names[:2] else n for n in names]).collect())) for d in (live, plan))
    assert a == b and len(a) > 20


def test_a_late_batch_is_left_out(spark, tmp_path):
    t, n = 1_710_000_000_000, 10**12
    parts = [[odd_batch("d1", 1, t, n)], [odd_batch("d1", 2, t + 3_600_000, n + 3_600_000_000_000)], [odd_batch("d1", 3, t + 7_200_000, n + 7_200_000_000_000)], [odd_batch("d1", 4, t + 7_000, n + 7_000_000_000)]]
    out, _ = streamed(spark, tmp_path, [b for p in parts for b in p], parts, late="1 minute")
    assert rows(window_samples(out)) == rows(planned(spark, [p[0] for p in parts[:3]]))
