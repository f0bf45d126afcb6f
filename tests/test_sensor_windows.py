import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.plans import sensor_windows as S
from loomstead.sources.batches import read_batches


def batch(i: int, n: int = 500, device: str = "d" * 64, drop: str = "", package: str = "app.one") -> dict:
    base, wall = 10**9 + i * 5_010_000_000, 1_710_000_000_000 + i * 5_010
    rng = np.random.default_rng(i)
    data = []
    for kind, level in (("ACCELEROMETER", 9.81), ("GYROSCOPE", 0.0), ("MAGNETIC_FIELD", 30.0)):
        if kind != drop:
            data += [{"sensor_type": kind, "timestamp_elapsed_nanos": base + j * 10**7, "wall_time_estimated_millis": wall + j * 10, "x": float(rng.normal(0, 0.05)), "y": float(rng.normal(0, 0.05)), "z": level + float(rng.normal(0, 0.05)), "accuracy": 3} for j in range(n)]
    nodes = [{"class_name": "android.widget.EditText", "editable": True, "focused": True, "depth": 1, "bounds_grid": {"left": 0, "top": 0, "right": 10, "bottom": 5}}, {"class_name": "androidx.RecyclerView", "scrollable": True, "depth": 2, "bounds_grid": {"left": 0, "top": 5, "right": 10, "bottom": 10}}]
    return {
        "batch_id": f"00000000-0000-4000-8000-00000000000{i}", "device_id": device, "session_id": "u1", "record_type": "collection", "collection_source": "BUILTIN_TASK", "app_package_name": package, "task_category": "I1", "task_name": "type",
        "started_at_wall_millis": wall, "ended_at_wall_millis": wall + 5000, "base_elapsed_nanos": base, "sensor_samples": data, "context_features": [], "sampling_rate_hz": 100, "diagnostics": {},
        "touch_events": [{"event_id": f"t{i}", "event_type": "TOUCH_DOWN", "event_time_wall_millis": wall + 100}],
        "context_events": [{"event_id": f"e{i}", "event_type": "TYPE_VIEW_TEXT_CHANGED", "event_time_wall_millis": wall + 1000, "app_package_name": package, "root_nodes": nodes}],
    }


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    folder = root / "devices" / "d" / "2024-03-09"
    folder.mkdir(parents=True)
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps(batch(i)))
    (folder / "2.json").write_text(json.dumps({"record_type": "collection"}))
    (folder / "0.meta.json").write_text("{}")
    return read_batches(spark, str(root)).persist()


def test_reader_leaves_out_what_is_no_batch(batches):
    assert batches.count() == 2


def test_feature_vocabulary():
    assert {m: len(S.feature_columns(m)) for m in S.MODES} == {"sensor_only": 172, "ui_sensor": 204, "ui_sensor_no_package": 203, "privacy_coarse_ui": 203, "ui_only": 31, "package_only": 1}


def test_windows_of_two_batches(batches):
    out = S.windows_table(batches, "own.app", min_session_s=5.0).orderBy("window_index").collect()
    # ten seconds of samples: starts 0 to 5 keep their end within one stride of the last sample
    assert [r.window_index for r in out] == list(range(len(out))) and len(out) == 6
    first = out[0]
    assert first.acc_sample_count == 500 and first.mag_missing == 0.0 and abs(first.acc_z_mean - 9.81) < 0.02
    assert first.evt_textchanged_count == 1 and abs(first.evt_rate - 0.2) < 1e-12 and first.ui_editable_count == 1 and first.ui_list == 1
    assert first.weak_label_top1 == "I1" and first.task_category == "I1" and "missing_sensor" not in first.quality_flags
    assert abs(first.ui_bounds_occupancy - 1.0) < 1e-12


def test_numpy_agrees_on_a_window(batches):
    row = S.windows_table(batches, "own.app").where("window_index = 0").first()
    v = np.array([s["x"] for s in batch(0)["sensor_samples"] if s["sensor_type"] == "GYROSCOPE"])
    centred = v - v.mean()
    assert abs(row.gyro_x_std - v.std()) < 1e-9 and abs(row.gyro_x_jerk - (np.diff(v) ** 2).mean()) < 1e-9
    assert abs(row.gyro_x_zcr - (np.signbit(centred[1:]) != np.signbit(centred[:-1])).mean()) < 1e-9
    power = np.abs(np.fft.rfft(centred)) ** 2
    assert abs(row.gyro_x_domfreq - np.fft.rfftfreq(500, 0.01)[power.argmax()]) < 1e-6
    skew = ((centred / v.std()) ** 3).mean()
    assert abs(row.gyro_x_skew - skew) < 1e-6
