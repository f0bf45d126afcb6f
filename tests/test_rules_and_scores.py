import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.operators import features as X
from loomstead.operators import ingest as I
from loomstead.operators import scene_rules as R
from loomstead.operators import verification as V

CUES = {
    "I0": {"ui_stable_ms": 5000, "motion_energy_low": 0.9, "ui_surface_like": 1, "orient_landscape": 1},
    "I1": {"evt_textchanged_count": 3, "ui_focusable_count": 1, "ui_editable_count": 1, "evt_focus_count": 1},
    "I2": {"evt_click_count": 2, "evt_windowstate_count": 1, "ui_form_like_control_count": 2, "ui_checked_count": 1},
    "I3": {"evt_scroll_count": 2, "ui_scrollable_count": 1, "ui_list": 1, "evt_click_count": 1},
    "I4": {"evt_scroll_count": 2, "ui_webview": 1, "ui_stable_ms": 3000, "ui_scrollable_count": 1},
    "I5": {"touch_rate": 2, "ui_surface_like": 1, "motion_energy_mid": 0.5, "orient_landscape": 1, "evt_rate": 0.7},
    "I6": {"motion_energy_high": 0.5, "gyro_burst_count": 9, "evt_rate": 0.1, "ui_node_count_mean": 2},
}


def test_cues_lead_to_their_scene(spark):
    names = sorted({c for cues in CUES.values() for c in cues})
    df = spark.createDataFrame([(s, *(float(v.get(n, 0)) for n in names)) for s, v in CUES.items()], ["want", *names])
    out = R.weak_labels(df.withColumn("game_like_score", F.lit(9.0)), ["want"]).collect()
    assert all(r.want == r.top1 for r in out)
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in out)


def test_ties_prefer_the_later_scene(spark):
    r = R.weak_labels(spark.createDataFrame([(1,)], "i int"), ["i"]).first()
    assert [round(x, 6) for x in r.scores] == [1.0, -1.2, 0.0, 0.0, 0.7, 0.3, 0.3]
    assert r.topk == ["I0", "I4", "I6"]


def test_leakage_is_an_error():
    with pytest.raises(ValueError):
        R.guard_leakage(["a", "game_like_score"])


def test_spectrum_of_a_sine():
    t = np.arange(500) / 100
    s = X.spectrum_of(np.sin(2 * np.pi * 5 * t), 100.0)
    assert abs(s[0] - 5) < 1e-9 and s[4] > 0.99
    assert X.spectrum_of(np.ones(10), 100.0) == [0.0] * 6


def test_detection_goldens(spark):
    rows = [("a", i, s) for i, s in enumerate([0.9, 0.9, 0.2, 0.9, 0.9])] + [("b", i, s) for i, s in enumerate([0.9, 0.2, 0.2, 0.9])]
    df = spark.createDataFrame(rows, "k string, i int, s double").withColumn("r", F.col("s") < 0.5)
    hits = V.k_of_n(df, ["k"], ["i"], "r", 2, 3).where("alarm").groupBy("k").agg(F.min("i")).collect()
    assert [tuple(h) for h in hits] == [("b", 2)]
    first = {r.k: r.first_alarm for r in V.ewma_alarms(df, ["k"], ["i"], "r", 0.5).collect()}
    assert first["a"] is None and first["b"] == 2


def test_eer_against_bisection(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(round(s, 2)), int(l)) for g in range(4) for s, l in zip(rng.random(60) + np.repeat([0.3, 0], 30), np.repeat([1, 0], 30))]
    df = spark.createDataFrame(rows, "g int, score double, label int")
    got = {r.g: r.eer for r in V.eer(V.roc(df, "score", "label", ["g"]), ["g"]).collect()}
    for g in range(4):
        s, l = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        cuts = np.unique(s)[::-1]
        x = np.concatenate(([0], [((s >= c) & (l == 0)).sum() / 30 for c in cuts]))
        y = np.concatenate(([1], [1 - ((s >= c) & (l == 1)).sum() / 30 for c in cuts]))
        i = np.flatnonzero(y <= x)[0]
        u = np.linspace(0, 1, 200001)
        px, py = x[i - 1] + u * (x[i] - x[i - 1]), y[i - 1] + u * (y[i] - y[i - 1])
        assert abs(got[g] - px[np.argmin(np.abs(px - py))]) < 1e-4


def test_one_class_has_no_eer(spark):
    df = spark.createDataFrame([(0.5, 1), (0.6, 1)], "score double, label int")
    assert V.eer(V.roc(df, "score", "label")).count() == 0


def test_holm_golden(spark):
    df = spark.createDataFrame([(0.001,), (0.04,), (0.5,), (0.02,)], "p double")
    assert [round(r.p_adjusted, 6) for r in V.holm(df, "p").orderBy("p").collect()] == [0.004, 0.06, 0.08, 0.5]


def envelope(payload: bytes, **change) -> dict:
    import base64

    packed = pa.compress(payload, codec="lz4", asbytes=True)
    out = {
        "algorithm": I.ALGORITHM, "payload_base64": base64.b64encode(packed).decode(), "payload_sha256_hex": hashlib.sha256(packed).hexdigest(), "device_id": "a" * 64,
        "batch_id": "00000000-0000-4000-8000-000000000001", "rule_version": "1", "rule_hash": "b" * 64, "created_at_wall_millis": 5,
    }
    return out | change


def test_envelope_reasons(spark):
    body = json.dumps({"x": 1}).encode()
    bad = pa.py_buffer(b"\x04\x22\x4d\x18broken")
    import base64

    rows = [
        (None, envelope(body)), ("invalid_envelope", envelope(body, algorithm="zip")), ("invalid_envelope", envelope(body, device_id="A" * 64)), ("invalid_envelope", envelope(body, created_at_wall_millis=-1)),
        ("invalid_envelope", envelope(body, batch_id="nope")), ("invalid_base64", envelope(body, payload_base64="YW Jj")), ("invalid_base64", envelope(body, payload_base64="YWJ")),
        ("payload_hash_mismatch", envelope(body, payload_sha256_hex="0" * 64)),
        ("corrupted_lz4_payload", envelope(body, payload_base64=base64.b64encode(bad).decode(), payload_sha256_hex=hashlib.sha256(bad).hexdigest())), ("invalid_json", envelope(b"[1]")),
    ]
    df = spark.createDataFrame([(i, w, *e.values()) for i, (w, e) in enumerate(rows)], "i int, want string, algorithm string, payload_base64 string, payload_sha256_hex string, device_id string, batch_id string, rule_version string, rule_hash string, created_at_wall_millis bigint")
    got = [r.reason for r in I.decoded(df).orderBy("i").collect()]
    assert got == [w for w, _ in rows]


def test_uuid_spellings(spark):
    df = spark.createDataFrame([("{0000000000004000800000000000000A}",), ("urn:uuid:00000000-0000-4000-8000-00000000000a",), ("x",)], "u string")
    assert [r[0] for r in df.select(I.canonical_uuid(F.col("u"))).collect()] == ["00000000-0000-4000-8000-00000000000a"] * 2 + [None]


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("j", 1, "c")], "k string, i int, c string")
    assert [r.outcome for r in I.duplicates(df, ["k"], ["i"], "c").orderBy("k", "i").collect()] == ["stored", "stored", "duplicate", "conflict"]


def test_streaming_ingest(spark, tmp_path):
    from loomstead.streaming.pipelines import ingest_envelopes, outcome_counters

    batch = {"device_id": "a" * 64, "batch_id": "00000000-0000-4000-8000-000000000001", "started_at_wall_millis": 1710000000000, "x": 1}
    texts = [json.dumps(batch), json.dumps(batch, sort_keys=True, indent=1), json.dumps(batch | {"x": 2}), json.dumps(batch | {"device_id": "c" * 64})]
    (tmp_path / "in").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(envelope(t.encode(), created_at_wall_millis=i)))
    schema = "algorithm string, payload_base64 string, payload_sha256_hex string, device_id string, batch_id string, rule_version string, rule_hash string, created_at_wall_millis bigint"
    inner = "device_id string, batch_id string, started_at_wall_millis bigint, x bigint"
    for run in ("one", "two"):  # the second stream brings the same envelopes again
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest_envelopes(stream, inner, F.col("batch.x").isNotNull(), str(tmp_path / "out"), str(tmp_path / run)).awaitTermination(60)
    stored = spark.read.parquet(str(tmp_path / "out" / "batches")).collect()
    assert len(stored) == 1 and str(stored[0].day) == "2024-03-09" and json.loads(stored[0].plain)["x"] == 1
    reasons = sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out" / "errors")).collect())
    assert reasons == ["duplicate_batch_id_conflict"] * 2 + ["envelope_batch_device_id_mismatch"] * 2
    assert stored[0].decompressed_size_bytes == len(texts[0]) and len(stored[0].request_id) == 64
    rows = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert rows("idx_devices").count() == rows("idx_batches").count() == 1
    assert [(r.reason, r.top_keys) for r in rows("quarantine").collect()] == [("envelope_batch_device_id_mismatch", ["batch_id", "device_id", "started_at_wall_millis", "x"])] * 2
    counts = {(r.event, r.status): r.n for r in outcome_counters(rows("log")).collect()}
    assert counts == {("stored", 200): 1, ("duplicate", 200): 3, ("duplicate_batch_id_conflict", 409): 2, ("envelope_batch_device_id_mismatch", 400): 2}


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    from loomstead.streaming.pipelines import fan_out

    text = json.dumps({"device_id": "a" * 64, "batch_id": "00000000-0000-4000-8000-000000000001", "started_at_wall_millis": 1710000000000, "x": 1})
    micro = spark.createDataFrame([envelope(text.encode())])
    inner = "device_id string, batch_id string, started_at_wall_millis bigint, x bigint"
    for _ in range(2):
        fan_out(micro, 7, inner, str(tmp_path), F.lit(True))
    assert {n: spark.read.parquet(str(tmp_path / n)).count() for n in ("batches", "log", "errors", "idx_batches")} == {"batches": 1, "log": 1, "errors": 0, "idx_batches": 1}


def run_stream(spark, tmp_path, frame, schema, build):
    for i, part in enumerate(frame):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_live_detection_over_micro_batches(spark, tmp_path):
    from loomstead.streaming.pipelines import live_detection

    rng = np.random.default_rng(5)
    scores = {k: rng.random(30) for k in "ab"}
    parts = [[(k, i, float(scores[k][i])) for k in "ab" for i in rng.permutation(np.arange(lo, lo + 10)).tolist()] for lo in (0, 10, 20)]
    got = run_stream(spark, tmp_path, parts, "k string, t bigint, s double", lambda d: live_detection(d, "k", "t", "s", 0.5, 2, 3)).collect()
    for k in "ab":
        rejects, e = (scores[k] < 0.5).astype(int), 0.0
        rows = sorted((r for r in got if r.k == k), key=lambda r: r.t)
        assert [r.t for r in rows] == list(range(30))
        for i, r in enumerate(rows):
            e = 0.5 * rejects[i] + 0.5 * e
            assert r.alarm == (rejects[max(0, i - 2) : i + 1].sum() >= 2) and r.ewma_alarm == (e > 0.5)


def test_live_windows_over_micro_batches(spark, tmp_path):
    from loomstead.streaming.pipelines import live_windows

    times = [0, 5, 9, 12, 40, 43, 44, 90]
    parts = [[("a", t) for t in times[:3]], [("a", t) for t in times[3:6][::-1]], [("a", t) for t in times[6:]]]
    got = sorted(run_stream(spark, tmp_path, parts, "k string, t bigint", lambda d: live_windows(d, "k", "t", 10, 5, 2)).collect(), key=lambda r: r.t)
    starts = [0, 0, 0, 0, 40, 40, 40, 90]
    assert [(r.segment, r.rel) for r in got] == [({0: 0, 40: 1, 90: 2}[s], t - s) for t, s in zip(times, starts)]
    for r in got:  # window w covers [2 w, 2 w + 5)
        assert [w for w in range(60) if 2 * w <= r.rel < 2 * w + 5] == list(range(r.first_window, r.last_window + 1))


def test_roc_points_are_those_of_a_rounded_linspace(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(y)) for x, y in zip(rng.permutation(400) / 400, rng.integers(0, 2, 400))]
    tp, fp = (np.cumsum([y == c for _, y in sorted(rows, reverse=True)]) for c in (1, 0))
    turns = np.concatenate(([True], (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0), [True]))
    tpr, fpr = (np.concatenate(([0], x[turns] / x[-1])) for x in (tp, fp))
    curve = V.roc(spark.createDataFrame(rows, "score double, label int"), "score", "label")
    for most in (16, 512):
        at = np.linspace(0, len(fpr) - 1, most).round().astype(int) if len(fpr) > most else np.arange(len(fpr))
        out = V.roc_points(curve, most).orderBy("point").collect()
        assert np.allclose([(p.point, p.fpr, p.tpr) for p in out], list(zip(range(len(at)), fpr[at], tpr[at])))


def test_survey_rows_left_out_are_not_claimed():
    from loomstead.plans.catalog import QUERIES

    claimed = {x for q in QUERIES.values() for x in q.ops.split()}
    assert not claimed & {"N1", "N2", "N16", "N18", "N19", "N20", "H1", "H6", "O1", "O3"} and {"R1", "R2", "R3", "R4", "R6", "R7", "R8", "R9", "M12", "N6", "N8"} <= claimed
