"""From capture batches to the window table: order, sessions, windows, features, labels, flags.

The sample table goes through two shuffles: by device for order and sessions, by window for features. Events meet
windows through a time-bucketed join. `feature_columns` lists the feature vocabulary by mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, hash_number, local_day
from ..operators import features as X
from ..operators import scene_rules as R
from ..operators import timeline as T
from ..sources.batches import samples

# Fixed values of the batch contract and of the feature vocabulary.
CHANNELS = {"acc": "ACCELEROMETER", "gyro": "GYROSCOPE", "mag": "MAGNETIC_FIELD"}
TIME_STATS = ["mean", "std", "min", "max", "rms", "energy", "zcr", "jerk", "skew", "kurt"]
EVENTS = {
    "evt_click_count": "TYPE_VIEW_CLICKED", "evt_longclick_count": "TYPE_VIEW_LONG_CLICKED", "evt_scroll_count": "TYPE_VIEW_SCROLLED", "evt_textchanged_count": "TYPE_VIEW_TEXT_CHANGED",
    "evt_focus_count": "TYPE_VIEW_FOCUSED", "evt_windowstate_count": "TYPE_WINDOW_STATE_CHANGED", "evt_windowcontent_count": "TYPE_WINDOW_CONTENT_CHANGED",
}
UI = [
    "ui_node_count_mean", "ui_node_count_max", "ui_max_depth", "ui_clickable_count", "ui_editable_count", "ui_scrollable_count", "ui_focusable_count", "ui_editable_ratio", "ui_scrollable_ratio",
    "ui_checked_count", "ui_selected_count", "ui_surface_like", "ui_webview", "ui_list", "ui_scroll_indicator", "ui_form_like_control_count", "ui_bounds_occupancy", "ui_stable_ms",
    "ui_treediff_nodedelta", "ui_treediff_categoryl1", "ui_treediff_boundsl1", "ui_treediff_hashchanged",
]
MODES = {"sensor_only": "imu", "ui_sensor": "imu event ui package", "ui_sensor_no_package": "imu event ui", "privacy_coarse_ui": "imu event ui", "ui_only": "event ui", "package_only": "package"}


def feature_columns(mode: str = "ui_sensor") -> list[str]:
    """Feature names of a mode in their fixed order; never a leakage column."""
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}; known: {sorted(MODES)}")
    imu = []
    for ch in CHANNELS:
        imu += [f"{ch}_{ax}_{f}" for ax in "xyz" for f in (*TIME_STATS, *X.SPECTRUM)] + [f"{ch}_{f}" for f in ("mag_mean", "mag_std", "mag_energy", "sample_count", "missing")]
    imu += ["orient_pitch_mean", "orient_pitch_std", "orient_roll_mean", "orient_roll_std", "orient_heading_stability", "orient_landscape"]
    imu += ["corr_acc_gyro", "corr_acc_mag", "corr_gyro_mag", "motion_energy_low", "motion_energy_mid", "motion_energy_high", "gyro_burst_count"]
    family = {"imu": imu, "event": [*EVENTS, "evt_rate", "evt_entropy"], "ui": UI, "package": ["pkg_bucket_hash"]}
    out = [c for f in MODES[mode].split() for c in family[f]]
    R.guard_leakage(out)
    return out


def windowed_samples(batches: DataFrame, size_s: float = 5.0, stride_s: float = 1.0, gap_min: float = 10.0, zone: str = "Asia/Shanghai", min_session_s: float = 5.0) -> DataFrame:
    """The sample table with sessions and the windows of each sample."""
    s = samples(batches).withColumn("day", local_day("wall", zone))
    order = ["batch_order", "timestamp_elapsed_nanos", "sensor_type", "pos"]
    s = T.clock_gaps(s, "device_id", order, "wall", int(gap_min * 60_000), "base_elapsed_nanos", "batch_id")
    s = T.sessionize(s, "device_id", order, "day", ["uploaded_session_id", F.col("clock_backward"), F.col("time_gap"), "app_package_name"])
    s = T.drop_short_sessions(s, "wall", min_session_s)
    s = T.session_axis(s, "timestamp_elapsed_nanos", 10_000_000)
    return T.sliding_windows(s, round(size_s * 1e9), round(stride_s * 1e9))


KEYS = ["session_id", "window_index"]


def imu_features(w: DataFrame) -> DataFrame:
    """The imu family per window. One aggregation on (window, channel) serves all axes of a channel."""
    rows = w.withColumn("ch", F.expr("CASE " + " ".join(f"WHEN sensor_type = '{t}' THEN '{c}'" for c, t in CHANNELS.items()) + " END")).where("ch IS NOT NULL")
    by = [*KEYS, "ch"]
    group, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("batch_order", "timestamp_elapsed_nanos", "pos")
    rows = rows.withColumn("m", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).withColumn("i", F.row_number().over(ordered))
    rows = rows.withColumn("dt", F.col("timestamp_elapsed_nanos") - F.lag("timestamp_elapsed_nanos").over(Window.partitionBy(*by).orderBy("timestamp_elapsed_nanos")))
    for ax in "xyz":
        rows = rows.withColumn(f"side_{ax}", (F.col(ax) - F.avg(ax).over(group)) < 0)
    for ax in "xyz":
        rows = rows.withColumn(f"turn_{ax}", (F.col(f"side_{ax}") != F.lag(f"side_{ax}").over(ordered)).cast("double")).withColumn(f"step_{ax}", F.col(ax) - F.lag(ax).over(ordered))
    aggs = []
    for ax in "xyz":
        aggs += X.time_stats(ax, ax)
        aggs += [F.coalesce(F.avg(f"turn_{ax}"), F.lit(0.0)).alias(f"{ax}_zcr"), F.coalesce(F.avg(F.col(f"step_{ax}") * F.col(f"step_{ax}")), F.lit(0.0)).alias(f"{ax}_jerk")]
        aggs.append(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col(ax).alias("v")))), lambda r: r["v"]).alias(f"{ax}_values"))
    aggs += [F.avg("m").alias("mag_mean"), F.stddev_pop("m").alias("mag_std"), F.avg(F.col("m") * F.col("m")).alias("mag_energy"), F.count(F.lit(1)).cast("double").alias("sample_count")]
    aggs += [*X.orientation("x", "y", "z"), X.heading_stability("x", "y"), (F.lit(1e9) / F.median(F.when(F.col("dt") > 0, F.col("dt")))).alias("fs")]
    motion = F.when(F.col("ch") == "gyro", F.col("m")).when(F.col("ch") == "acc", F.abs(F.col("m") - 9.81))
    aggs += X.motion_bins(motion)
    per = rows.groupBy(*by).agg(*aggs)
    names = [c for c in per.columns if c not in by]
    wide = per.groupBy(*KEYS).pivot("ch", list(CHANNELS)).agg(F.first(F.struct(*names)))
    pick = lambda ch, f, default=0.0: F.coalesce(F.col(f"{ch}.{f}").cast("double"), F.lit(default))
    rate = F.coalesce("acc.fs", "gyro.fs", "mag.fs", F.lit(100.0))
    wide = wide.withColumn("_fs", rate)
    out = wide
    spectrum = F.arrow_udf(_spectra, "array<double>")
    for ch in CHANNELS:
        for ax in "xyz":
            out = out.withColumn(f"_s_{ch}_{ax}", spectrum(F.coalesce(F.col(f"{ch}.{ax}_values"), F.array().cast("array<double>")), F.col("_fs")))
    pairs = rows.select(*KEYS, "i", "ch", "m").groupBy(*KEYS, "i").pivot("ch", list(CHANNELS)).agg(F.first("m"))
    corr = pairs.groupBy(*KEYS).agg(*[guarded_corr_of(a, b).alias(f"corr_{a}_{b}") for a, b in (("acc", "gyro"), ("acc", "mag"), ("gyro", "mag"))])
    columns = []
    for ch in CHANNELS:
        for ax in "xyz":
            columns += [pick(ch, f"{ax}_{f}").alias(f"{ch}_{ax}_{f}") for f in TIME_STATS] + [F.col(f"_s_{ch}_{ax}")[i].alias(f"{ch}_{ax}_{f}") for i, f in enumerate(X.SPECTRUM)]
        columns += [pick(ch, f).alias(f"{ch}_{f}") for f in ("mag_mean", "mag_std", "mag_energy", "sample_count")] + [F.col(ch).isNull().cast("double").alias(f"{ch}_missing")]
    columns += [pick("acc", f).alias(f"orient_{f}") for f in ("pitch_mean", "pitch_std", "roll_mean", "roll_std")]
    columns += [pick("mag", "heading_stability").alias("orient_heading_stability"), pick("acc", "landscape").alias("orient_landscape")]
    source = lambda f: F.coalesce(F.col(f"gyro.{f}").cast("double"), F.col(f"acc.{f}").cast("double"), F.lit(0.0))
    columns += [source("motion_low").alias("motion_energy_low"), source("motion_mid").alias("motion_energy_mid"), source("motion_high").alias("motion_energy_high"), source("bursts").alias("gyro_burst_count")]
    return out.select(*KEYS, *columns).join(corr, KEYS)


def guarded_corr_of(a: str, b: str):
    """Correlation of two channels over the positions that both have."""
    return guarded_corr(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(b)))


def _spectra(values, rates):
    import numpy as np
    import pyarrow as pa

    return pa.array([X.spectrum_of(np.asarray(v.values.to_numpy(zero_copy_only=False), float), r.as_py()) for v, r in zip(values, rates)], pa.list_(pa.float64()))


def window_events(windows: DataFrame, batches: DataFrame, children: str, at: str) -> DataFrame:
    """(session_id, window_index, e): children (context or touch events) of the session's batches inside each window's wall bounds."""
    own = batches.select("batch_id", F.posexplode(children).alias("pos", "e")).withColumn("at", F.col(f"e.{at}"))
    held = windows.select(*KEYS, "start_wall", "end_wall", F.explode("batch_ids").alias("batch_id"))
    return T.range_attach(held, own, ["batch_id"], "start_wall", "end_wall", "at", 1000).select(*KEYS, "at", "pos", "batch_id", "e")


def windows_table(batches: DataFrame, self_package: str, mode: str = "ui_sensor", size_s: float = 5.0, stride_s: float = 1.0, **options) -> DataFrame:
    """One row per window: ids, bounds, the mode's features, weak labels, flags and the task's category. Windows of
    `self_package` (the collecting app) outside a task are left out; channels a window lacks count as missing."""
    w = windowed_samples(batches, size_s, stride_s, **options)
    # every batch of a session may hold events of any of its windows
    session_batches = w.groupBy("session_id").agg(F.collect_set("batch_id").alias("batch_ids"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("batch_order", "timestamp_elapsed_nanos", "pos")))
    base = w.groupBy(*KEYS).agg(
        F.min("device_id").alias("device_id"), F.min("day").alias("day_id"), F.min("rel").alias("first_rel"), F.min("k").alias("k"), F.min("wall").alias("start_wall"), (F.max("wall") + 1).alias("end_wall"),
        F.mode("app_package_name", True).alias("package_bucket"), F.countDistinct("app_package_name").alias("_packages"), F.count(F.lit(1)).alias("n_samples"), F.countDistinct("sensor_type").alias("_channels"),
        first("task_category").alias("raw_task_category"), first("task_name").alias("_task_name"), F.bool_or("clock_backward").alias("_restart"), F.bool_or("time_gap").alias("_gap"),
    ).join(session_batches, "session_id")
    by_session = Window.partitionBy("session_id")
    base = base.withColumn("_restart", F.bool_or("_restart").over(by_session)).withColumn("_gap", F.bool_or("_gap").over(by_session))
    base = base.where(~(F.col("raw_task_category").isNull() & (F.col("package_bucket") == self_package)))
    seconds = max(1e-9, size_s)
    events = window_events(base, batches, "context_events", "event_time_wall_millis")
    kinds = events.groupBy(*KEYS, "e.event_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    mix = kinds.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("n"))), F.lit(0)).cast("double").alias(c) for c, t in EVENTS.items()], (n / F.lit(seconds)).alias("evt_rate"), (F.ln(n) - F.sum(F.col("n") * F.ln("n")) / n).alias("evt_entropy"))
    ordered = F.struct("at", "batch_id", "pos")
    nodes = events.withColumn("nodes", F.coalesce("e.root_nodes", F.array().cast("array<" + _node_type(batches) + ">")))
    full = F.when(F.size("nodes") > 0, ordered)
    ui = nodes.groupBy(*KEYS).agg(F.max_by("nodes", full).alias("nodes"), F.avg(F.when(F.size("nodes") > 0, F.size("nodes"))).alias("ui_node_count_mean"), F.max(F.size("nodes")).cast("double").alias("ui_node_count_max"), F.max_by("nodes", ordered).alias("_last"), F.min_by("nodes", full).alias("_first"), F.count_if(F.size("nodes") > 0).alias("_full"), F.countDistinct("e.app_package_name").alias("_event_packages"))
    touches = window_events(base, batches, "touch_events", "event_time_wall_millis").groupBy(*KEYS).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("touch_rate"))
    out = base.join(imu_features(w), KEYS, "left").join(mix, KEYS, "left").join(ui, KEYS, "left").join(touches, KEYS, "left")
    out = T.carry_previous(out, ["session_id"], ["window_index"], "_last", "_previous")
    out = X.node_features(out, "nodes")
    reference = F.when(F.size("_previous") > 0, F.col("_previous")).when(F.col("_full") >= 2, F.col("_first"))
    buckets = ["edit", "list", "switch", "webview", "surface", "button", "text", "other"]
    histogram = lambda c: F.array(*[F.size(F.filter(c, X.in_bucket(b))) for b in buckets])
    line = lambda x: F.concat_ws("|", X.class_bucket(x["class_name"]), *[F.coalesce(x[f], F.lit(False)).cast("int").cast("string") for f in ("clickable", "editable", "scrollable", "checkable")], F.coalesce(x["depth"], F.lit(0)).cast("string"))
    out = out.withColumn("_ref", reference)
    ref, now = F.col("_ref"), F.col("nodes")
    both = ref.isNotNull() & now.isNotNull()
    none_now = now.isNull() & (F.size("_previous") > 0)
    out = (
        out.withColumn("ui_treediff_nodedelta", F.when(both, F.abs(F.size(now) - F.size(ref))).when(none_now, F.size("_previous")).otherwise(0).cast("double"))
        .withColumn("ui_treediff_categoryl1", F.when(both, F.aggregate(F.zip_with(histogram(now), histogram(ref), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)).otherwise(0).cast("double"))
        .withColumn("ui_treediff_boundsl1", F.when(both, F.abs(X.occupancy(now) - X.occupancy(ref))).otherwise(0.0))
        .withColumn("ui_treediff_hashchanged", F.when(both, X.structural_hash(F.transform(now, line)) != X.structural_hash(F.transform(ref, line))).otherwise(none_now).cast("double"))
        .withColumn("ui_stable_ms", F.when(now.isNull(), size_s * 1000.0).otherwise(size_s * 1000.0 / (1 + F.coalesce(F.col("evt_windowcontent_count"), F.lit(0.0)) + F.coalesce(F.col("evt_windowstate_count"), F.lit(0.0)))))
        .withColumn("ui_scroll_indicator", (F.coalesce(F.col("ui_scrollable_count"), F.lit(0.0)) > 0).cast("double"))
        .withColumn("pkg_bucket_hash", (hash_number(F.col("package_bucket"), 8) % 1024).cast("double"))
    )
    every = feature_columns("ui_sensor")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c.endswith("_missing") else 0.0)) for c in [*every, "touch_rate"]})
    labels = R.weak_labels(out, KEYS)
    named = out.join(labels, KEYS)
    flags = R.quality_flags({
        "missing_sensor": F.col("acc_missing") + F.col("gyro_missing") + F.col("mag_missing") > 0, "low_record_count": F.col("n_samples") < 30, "missing_ui": F.coalesce(F.col("_full"), F.lit(0)) == 0, "service_restart": F.col("_restart"), "time_gap": F.col("_gap"),
        "app_transition_window": (F.col("_packages") > 1) | (F.coalesce(F.col("_event_packages"), F.lit(0)) > 1),
    }, F.col("low_confidence"))
    ids = [
        "device_id", "session_id", "day_id", F.concat_ws(":", "device_id", "session_id", F.col("window_index").cast("string")).alias("window_id"), F.col("device_id").alias("user_id"), "package_bucket", "window_index",
        F.col("start_wall").alias("start_wall_ms"), F.col("end_wall").alias("end_wall_ms"),
    ]
    tail = [F.col("top1").alias("weak_label_top1"), F.col("topk").alias("weak_label_topk"), F.col("probs").alias("weak_label_probs"), F.col("confidence").alias("weak_label_confidence"), F.col("entropy").alias("weak_label_entropy"), F.col("low_confidence").alias("weak_label_low_confidence"), flags.alias("quality_flags")]
    tail += [R.canonical_scene(F.col("raw_task_category"), F.col("_task_name")).alias("task_category"), "raw_task_category"]
    return named.select(*ids, *feature_columns(mode), *tail)


def _node_type(batches: DataFrame) -> str:
    event = batches.schema["context_events"].dataType.elementType
    return event["root_nodes"].dataType.elementType.simpleString()


def preprocess_report(windows: DataFrame) -> DataFrame:
    """One row: windows, devices, sessions, low-confidence windows, agreement of weak and task labels."""
    gold = F.col("task_category").isNotNull()
    return windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.countDistinct("device_id").alias("n_devices"), F.countDistinct("session_id").alias("n_sessions"), F.count_if("weak_label_low_confidence").alias("n_low_confidence"),
        F.count_if(gold).alias("n_gold"), F.avg(F.when(gold, (F.col("weak_label_top1") == F.col("task_category")).cast("double"))).alias("agreement"),
    )
