"""Synthetic capture batches by the batch contract, of any size, by built-in functions: a row's values are hashes of the
seed and its place, so the same call gives the same batches whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import enveloped
from .batches import BATCH

RATE, SECONDS, START = 100, 5, 1_710_000_000_000

#: Per scene: motion of hand and wrist, events, widget classes of the screen, touches a batch.
SCENES = [
    ("I0", 0.02, 0.01, ["TYPE_WINDOW_CONTENT_CHANGED"], ["android.view.SurfaceView", "android.widget.TextView"], 0),
    ("I1", 0.08, 0.05, ["TYPE_VIEW_TEXT_CHANGED", "TYPE_VIEW_FOCUSED"], ["android.widget.EditText", "android.widget.Button"], 3),
    ("I2", 0.10, 0.08, ["TYPE_VIEW_CLICKED", "TYPE_WINDOW_STATE_CHANGED"], ["android.widget.Switch", "android.widget.Button"], 4),
    ("I3", 0.15, 0.10, ["TYPE_VIEW_SCROLLED", "TYPE_VIEW_CLICKED"], ["androidx.recyclerview.widget.RecyclerView", "android.widget.TextView"], 3),
    ("I4", 0.06, 0.04, ["TYPE_VIEW_SCROLLED", "TYPE_VIEW_LONG_CLICKED"], ["android.webkit.WebView", "android.widget.TextView"], 1),
    ("I5", 0.40, 0.30, ["TYPE_WINDOW_CONTENT_CHANGED", "TYPE_VIEW_CLICKED"], ["android.view.TextureView", "android.widget.Button"], 6),
    ("I6", 1.20, 0.90, ["TYPE_WINDOW_STATE_CHANGED"], ["android.widget.TextView", "android.widget.ImageView"], 0),
]


def synthetic_batches(spark: SparkSession, users: int = 5, days: int = 2, sessions: int = 2, batches: int = 4, seed: int = 42) -> DataFrame:
    """One row per batch: its columns as read_batches gives them, and `raw`. Users differ by a bias, sessions by their
    scene; one session in seven belongs to another app's capture, without a task."""
    n = users * days * sessions * batches
    ids = spark.range(n).select("id", *[F.floor(F.col("id") / size % count).cast("bigint").alias(name) for name, size, count in (("b", 1, batches), ("s", batches, sessions), ("d", batches * sessions, days), ("u", batches * sessions * days, users))])
    noise = lambda *parts: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *parts), F.lit(20_001)) / 10_000 - 1).cast("double")  # noqa: E731  -1 to 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("scene") + 1).cast("int"))
    text = lambda *parts: F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    rows = ids.withColumn("scene", F.pmod(F.xxhash64(F.lit(seed), "u", "d", "s"), F.lit(len(SCENES))))
    rows = rows.withColumn("task", F.pmod(F.xxhash64(F.lit(seed + 1), "u", "d", "s"), F.lit(7)) > 0)
    rows = rows.withColumn("at", F.lit(START) + F.col("d") * 86_400_000 + F.col("s") * 3_600_000 + F.col("b") * (SECONDS * 1000 + 20))
    rows = rows.withColumn("nanos", F.lit(10**9) + (F.col("at") - START) * 1_000_000)
    bias, hand, wrist = (F.col("u") + 1) * 0.01, pick([x[1] for x in SCENES]), pick([x[2] for x in SCENES])

    # batches differ in how fast they move and in how much happens
    pace, more = F.pmod(F.xxhash64(F.lit("pace"), "id"), F.lit(5)) * 0.2 + 0.8, F.pmod(F.xxhash64(F.lit("more"), "id"), F.lit(3)).cast("int") + 1

    def channel(name: str, number: int, level: Column, swing: Column) -> Column:
        def sample(j: Column) -> Column:
            wave = lambda axis, f: F.sin(j * pace * (2 * math.pi * f / RATE) + axis) * swing + noise(F.lit(number * 3 + axis), j) * swing * 0.5 + bias * (axis + 1)
            return F.struct(
                F.lit(name).alias("sensor_type"), (F.col("nanos") + j * (10**9 // RATE)).alias("timestamp_elapsed_nanos"), (F.col("at") + j * (1000 // RATE)).alias("wall_time_estimated_millis"),
                wave(0, 1.5).alias("x"), wave(1, 4.0).alias("y"), (wave(2, 9.0) + level).alias("z"), F.lit(3).alias("accuracy"),
            )

        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(RATE * SECONDS - 1).cast("bigint")), sample)

    samples = F.concat(channel("ACCELEROMETER", 0, F.lit(9.81), hand), channel("GYROSCOPE", 1, F.lit(0.0), wrist), channel("MAGNETIC_FIELD", 2, F.lit(30.0), hand * 10))
    scene = lambda place, k: F.element_at(pick_list(place), (F.pmod(k, F.size(pick_list(place))) + 1).cast("int"))
    pick_list = lambda place: F.element_at(F.array(*[F.array(*[F.lit(v) for v in x[place]]) for x in SCENES]), (F.col("scene") + 1).cast("int"))

    def node(k: Column, j: Column) -> Column:
        kind = scene(4, j)
        box = F.struct(F.lit(0).alias("left"), (j * 20).alias("top"), F.lit(45).alias("right"), ((j + 1) * 20 + F.when(j == 0, 40).otherwise(0)).alias("bottom"))
        odd = F.pmod(F.xxhash64("id", k, j), F.lit(3)) == 0
        return F.struct(
            F.concat_ws("-", F.lit("n"), k.cast("string"), j.cast("string")).alias("node_id"), kind.alias("class_name"), box.alias("bounds_grid"), odd.alias("clickable"), kind.contains("Edit").alias("editable"),
            (kind.contains("Recycler") | kind.contains("Web")).alias("scrollable"), kind.contains("Switch").alias("checkable"), (kind.contains("Switch") & odd).alias("checked"), odd.alias("focused"), (j == 1).alias("selected"), j.alias("depth"),
        )

    def event(k: Column) -> Column:
        many = F.pmod(F.xxhash64("id", k), F.lit(4)) + 2
        return F.struct(
            F.concat_ws("-", F.lit("e"), F.col("id").cast("string"), k.cast("string")).alias("event_id"), scene(3, k).alias("event_type"), (F.col("at") + 400 + k * 1300).alias("event_time_wall_millis"), F.lit("app.one").alias("app_package_name"),
            F.lit("portrait").alias("coarse_orientation"), F.transform(F.sequence(F.lit(0), many.cast("int")), lambda j: node(k, j)).alias("root_nodes"), F.create_map(F.lit("from_index"), F.lit(-1)).alias("event_detail"),
        )

    touch = lambda k: F.struct(F.concat_ws("-", F.lit("t"), F.col("id").cast("string"), k.cast("string")).alias("event_id"), F.lit("TOUCH_DOWN").alias("event_type"), *[(F.col("at") + 200 + k * 700).alias(c) for c in ("event_time_uptime_millis", "event_time_wall_millis", "collected_at_wall_millis")])
    touches = F.transform(F.sequence(F.lit(1), F.lit(8)), touch)
    own = lambda c: F.when(F.col("task"), c)
    category = pick([x[0] for x in SCENES])
    fields = {"task_sequence": F.col("scene"), "task_id": category, "task_name": F.concat(F.lit("task "), category), "task_intuitive_description": F.lit("a task"), "task_category": category, "task_session_id": F.concat_ws("-", F.lit("t"), "u", "d", "s")}
    source = F.when(F.col("task"), "BUILTIN_TASK").otherwise("THIRD_PARTY_APP")
    rows = rows.withColumn("context_events", F.transform(F.sequence(F.lit(0), more), event)).withColumn("touch_events", F.slice(touches, F.lit(1), pick([x[5] for x in SCENES]))).withColumn("sensor_samples", samples)
    feature = lambda e: F.struct(F.concat(F.lit("f"), e["event_id"]).alias("feature_id"), e["event_id"].alias("event_id"), F.col("at").alias("computed_at_wall_millis"), source.alias("collection_source"), *[own(c).alias(n) for n, c in fields.items()])
    device, hexes = text(F.lit("user"), F.col("u")), text(F.lit("batch"), F.col("id"))
    number = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.concat(F.lit("4"), F.substring(hexes, 14, 3)), F.concat(F.lit("8"), F.substring(hexes, 18, 3)), F.substring(hexes, 21, 12))
    counts = F.struct(F.size("sensor_samples").alias("sensor_sample_count"), F.size("context_events").alias("context_event_count"), F.size("touch_events").alias("touch_event_count"), F.lit(True).alias("redaction_applied"), F.lit("lz4_frame").alias("compression"), F.lit("none").alias("encryption"), F.lit(RATE).alias("sampling_rate_hz"))
    document = F.struct(
        number.alias("batch_id"), device.alias("device_id"), F.concat_ws("-", F.lit("s"), "u", "d", "s").alias("session_id"), F.lit("collection").alias("record_type"), source.alias("collection_source"), F.lit("app.one").alias("app_package_name"),
        F.lit(RATE).alias("sampling_rate_hz"), F.lit(SECONDS).alias("batch_duration_seconds"), *[own(c).alias(n) for n, c in fields.items()], own(F.col("at")).alias("task_started_at_wall_millis"), own(F.lit(SECONDS)).alias("task_elapsed_seconds_at_batch_end"),
        *[F.lit("1").alias(c) for c in ("app_version", "rule_version", "rule_hash", "consent_version")], F.col("at").alias("started_at_wall_millis"), (F.col("at") + SECONDS * 1000).alias("ended_at_wall_millis"), F.col("nanos").alias("base_elapsed_nanos"),
        "sensor_samples", "touch_events", "context_events", F.transform("context_events", feature).alias("context_features"), counts.alias("diagnostics"),
    )
    raw = rows.select(F.to_json(document).alias("raw"))
    return raw.select("raw", F.from_json("raw", BATCH).alias("b")).select("raw", "b.*")


def synthetic_envelopes(batches: DataFrame) -> DataFrame:
    """The envelopes of batches, as an ingest stream brings them."""
    out = enveloped(batches.select("raw", "device_id", "batch_id", F.col("ended_at_wall_millis").alias("created_at_wall_millis")), "raw")
    return out.withColumns({"rule_version": F.lit("1"), "rule_hash": F.sha2(F.lit("rules"), 256)}).drop("raw")
