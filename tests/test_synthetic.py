import json

import pytest
from pyspark.sql import functions as F

from loomstead.operators import ingest as I
from loomstead.plans import sensor_windows as S
from loomstead.sources.batches import BATCH, device_ids, read_batches, write_csv, write_jsonl
from loomstead.sources.synthetic import synthetic_batches, synthetic_envelopes


@pytest.fixture(scope="module")
def batches(spark):
    return synthetic_batches(spark, users=3, days=2, sessions=2, batches=3).persist()


def test_batches_keep_the_contract(spark, batches):
    assert batches.count() == 36 and batches.select("raw", F.from_json("raw", BATCH).alias("batch")).where(~I.batch_ok("batch", "raw")).count() == 0
    assert batches.select("batch_id").distinct().count() == 36
    again = synthetic_batches(spark, users=3, days=2, sessions=2, batches=3).repartition(5)
    assert {r.raw for r in again.select("raw").collect()} == {r.raw for r in batches.select("raw").collect()}


def test_envelopes_go_through_ingest(batches):
    rated = I.rated(synthetic_envelopes(batches.limit(4)), BATCH)
    assert [r.reason for r in rated.select("reason").collect()] == [None] * 4


def test_features_of_generated_windows_are_not_trivial(batches):
    table = S.windows_table(batches, "own.app", min_session_s=1.0).toPandas()
    names = S.feature_columns("ui_sensor")
    assert len(names) == 204 and len(table) > 100 and not table[names].isna().any().any()
    still = {c for c in names if table[c].nunique() <= 1}
    # nothing is missing, every event is of one app in portrait, and every window has a screen
    assert still <= {"acc_missing", "gyro_missing", "mag_missing", "orient_landscape", "pkg_bucket_hash", "acc_sample_count", "gyro_sample_count", "mag_sample_count"} | {c for c in still if c.startswith("ui_") and table[c].iloc[0] != 0}
    assert table.weak_label_top1.nunique() > 2 and set(table.task_category.dropna()) <= {f"I{i}" for i in range(7)}


def test_a_batch_without_channels_keeps_its_windows(spark, batches):
    dumb = batches.withColumn("sensor_samples", F.transform("sensor_samples", lambda s: s.withField("sensor_type", F.lit("LIGHT"))))
    row = S.windows_table(dumb, "own.app", min_session_s=1.0).first()
    assert (row.acc_missing, row.gyro_missing, row.mag_missing, row.acc_x_mean) == (1.0, 1.0, 1.0, 0.0) and "missing_sensor" in row.quality_flags


def test_tree_of_devices(spark, batches, tmp_path):
    for r in batches.select("raw", "device_id", "batch_id").collect():
        folder = tmp_path / "devices" / r.device_id
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{r.batch_id}.json").write_text(r.raw)
    (tmp_path / "by_category").mkdir()
    (tmp_path / "by_category" / "x.json").write_text(batches.first().raw)
    ids = device_ids(spark, str(tmp_path))
    assert len(ids) == 3 and read_batches(spark, str(tmp_path)).count() == 36 and read_batches(spark, str(tmp_path), device_id=ids[0]).count() == 12
    assert device_ids(spark, str(tmp_path / "devices")) == []


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string")
    write_csv(frame, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["n", "t"]
    write_jsonl(frame, str(tmp_path / "log"))
    line = json.loads(next(p for p in (tmp_path / "log").iterdir() if p.suffix == ".json").read_text().splitlines()[0])
    assert list(line) == sorted(line) and set(line) == {"n", "t", "ts"}
