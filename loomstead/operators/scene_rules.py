"""Weak labels of windows: additive rules for seven scenes, softmax, top scenes, confidence; quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip01, softmax

SCENES = ["I0", "I1", "I2", "I3", "I4", "I5", "I6"]

#: Fixed values: (scene, weight, condition, name of the fired rule). Conditions are SQL over window features.
MOTION = "(motion_energy_high > 0.2 OR motion_energy_mid > 0.3 OR gyro_burst_count > 5 OR gyro_mag_mean > 0.5)"
RULES = [
    ("I0", 1.0, "evt_rate < 0.6", "low_event_rate"),
    ("I0", 0.8, "ui_stable_ms > 1500", "stable_ui"),
    ("I0", 0.9, "motion_energy_low > 0.7", "low_motion"),
    ("I0", 1.0, "ui_surface_like > 0.5 AND motion_energy_high < 0.1", "media_surface_lowmotion"),
    ("I0", 0.6, "orient_landscape > 0.5 AND motion_energy_high < 0.1", "landscape_video"),
    ("I0", -1.5, "evt_textchanged_count > 0", "-text_changed"),
    ("I0", -1.2, "evt_scroll_count > 0", "-scroll"),
    ("I0", -0.6, "evt_click_count > 0", "-click"),
    ("I0", -1.4, "motion_energy_high > 0.2", "-high_motion"),
    ("I1", 1.6, "evt_textchanged_count > 0", "text_changed"),
    ("I1", 1.0, "ui_focusable_count > 0 AND ui_editable_count > 0", "focused_editable"),
    ("I1", 0.9, "ui_editable_count > 0", "editable_nodes"),
    ("I1", 0.5, "evt_focus_count > 0", "focus_events"),
    ("I1", -1.2, "ui_editable_count <= 0", "-no_editable"),
    ("I2", 1.2, "evt_click_count > 0 OR evt_longclick_count > 0", "click"),
    ("I2", 0.9, "evt_windowstate_count > 0", "window_state_changed"),
    ("I2", 0.9, "ui_form_like_control_count > 0", "form_like_controls"),
    ("I2", 0.8, "ui_checked_count > 0 OR ui_selected_count > 0", "checked_or_selected"),
    ("I2", 0.5, "ui_treediff_nodedelta > 4 OR ui_treediff_categoryl1 > 3", "large_tree_diff"),
    ("I2", -1.0, "evt_textchanged_count > 0", "-text_changed"),
    ("I2", -1.2, "evt_scroll_count >= 3", "-sustained_scroll"),
    ("I2", -1.0, "ui_surface_like > 0.5 AND ui_node_count_mean < 6", "-pure_media_or_canvas"),
    ("I3", 1.1, "evt_scroll_count > 0", "scroll"),
    ("I3", 0.6, "ui_scrollable_count > 0", "scrollable_nodes"),
    ("I3", 1.2, "ui_list > 0.5", "list_container"),
    ("I3", 0.6, "evt_click_count > 0 OR ui_selected_count > 0", "item_select"),
    ("I3", 0.3, "evt_scroll_count >= 2", "flick_rhythm"),
    ("I3", -1.0, "evt_textchanged_count > 0", "-text_changed"),
    ("I3", -0.8, "ui_webview > 0.5 AND ui_list < 0.5", "-doc_container"),
    ("I4", 1.1, "evt_scroll_count > 0", "scroll"),
    ("I4", 1.2, "ui_webview > 0.5", "doc_container"),
    ("I4", 0.7, "evt_click_count <= 0", "near_zero_click"),
    ("I4", 0.5, "ui_stable_ms > 2000", "long_dwell"),
    ("I4", 0.4, "ui_list < 0.5 AND ui_scrollable_count > 0", "continuous_scroll_not_list"),
    ("I4", -1.0, "ui_list > 0.5", "-list_container"),
    ("I4", -0.5, "evt_click_count > 0", "-clicks"),
    ("I4", -1.0, "evt_textchanged_count > 0", "-text_changed"),
    ("I5", 1.2, "touch_rate > 1.0", "high_touch_density"),
    ("I5", 0.9, "touch_rate > 0.5 AND ui_surface_like > 0.5", "large_canvas"),
    ("I5", 0.7, "motion_energy_mid > 0.3 OR motion_energy_high > 0.2", "mid_high_motion"),
    ("I5", 0.4, "orient_landscape > 0.5", "landscape"),
    ("I5", 0.3, "evt_rate < 0.8", "low_semantic_event_rate"),
    ("I5", -1.4, "motion_energy_high > 0.6 AND touch_rate < 0.5", "-pure_wrist_motion"),
    ("I5", -1.2, "motion_energy_low > 0.7 AND ui_stable_ms > 2000", "-static"),
    ("I6", 1.6, "motion_energy_high > 0.3", "high_motion_energy"),
    ("I6", 1.1, "gyro_burst_count > 5 OR gyro_mag_mean > 0.5", "gyro_burst"),
    ("I6", 0.8, f"{MOTION} AND touch_rate < 0.5", "near_zero_touch"),
    ("I6", 0.4, f"{MOTION} AND evt_rate < 0.6", "low_ui_event_rate"),
    ("I6", 0.3, "ui_node_count_mean < 8", "low_node_count"),
    ("I6", -1.2, "touch_rate > 1.0", "-high_touch"),
    ("I6", -1.4, "motion_energy_low > 0.7 AND ui_stable_ms > 2000", "-low_motion_stable_ui"),
]

#: The features that rules may read; what a frame lacks counts as 0, anything else never reaches a rule.
READABLE = [
    "evt_click_count", "evt_longclick_count", "evt_scroll_count", "evt_textchanged_count", "evt_focus_count", "evt_windowstate_count", "evt_rate",
    "ui_node_count_mean", "ui_clickable_count", "ui_editable_count", "ui_scrollable_count", "ui_focusable_count", "ui_checked_count", "ui_selected_count", "ui_surface_like",
    "ui_webview", "ui_list", "ui_form_like_control_count", "ui_stable_ms", "ui_treediff_nodedelta", "ui_treediff_categoryl1",
    "motion_energy_low", "motion_energy_mid", "motion_energy_high", "gyro_burst_count", "gyro_mag_mean", "orient_landscape", "touch_rate",
]

#: Columns that would leak the label and must never be features (fixed values).
LEAKAGE = ["estimated_context_category", "game_like_score", "media_like_score", "list_like_score", "form_like_score", "viewIdResourceName", "coarse_orientation"]

FLAGS = ["missing_sensor", "low_record_count", "missing_ui", "service_restart", "time_gap", "app_transition_window", "privacy_violation"]


def guard_leakage(columns: list[str]) -> None:
    found = sorted(set(columns) & set(LEAKAGE))
    if found:
        raise ValueError(f"label leakage columns among features: {found}")


def score_sql(scene: str) -> str:
    """The scene's score as SQL that Spark and DuckDB share."""
    return " + ".join(["CAST(0 AS DOUBLE)", *(f"CASE WHEN {c} THEN CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for s, w, c, _ in RULES if s == scene)])


def readable(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in READABLE])


def weak_labels(df: DataFrame, keep: list[str], temperature: float = 1.0, low_probability: float = 0.35, low_margin: float = 0.1, k: int = 3) -> DataFrame:
    """keep plus scores, probs, fired, top1, topk, confidence, entropy, low_confidence. Equal scores: the later scene first."""
    k = max(1, min(len(SCENES), k))
    out = readable(df, keep).withColumn("scores", F.array(*[F.expr(score_sql(s)) for s in SCENES]))
    out = out.withColumn("fired", F.array_compact(F.array(*[F.when(F.expr(c), F.lit(f"{s}:{name}")) for s, _, c, name in RULES])))
    out = out.withColumn("probs", softmax(F.col("scores"), temperature))
    ranked = F.reverse(F.sort_array(F.transform("scores", lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    out = out.withColumn("_r", ranked)
    names = F.array(*[F.lit(s) for s in SCENES])
    out = out.withColumn("topk", F.transform(F.slice("_r", 1, k), lambda r: F.element_at(names, r["i"] + 1)))
    sorted_probs = F.sort_array("probs", asc=False)
    margin = clip01(sorted_probs[0] - sorted_probs[3])
    entropy = -F.aggregate(F.transform("probs", lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("top1", F.col("topk")[0]).withColumn("confidence", margin).withColumn("entropy", entropy)
    out = out.withColumn("low_confidence", (sorted_probs[0] < low_probability) | (F.col("confidence") < low_margin))
    return out.select(*keep, "scores", "probs", "fired", "top1", "topk", "confidence", "entropy", "low_confidence")


def quality_flags(conditions: dict[str, Column], low_confidence: Column | None = None) -> Column:
    """Names of the flags whose condition holds, in the vocabulary's order; the label's flag comes last."""
    tests = [F.when(conditions[f], F.lit(f)) for f in FLAGS if f in conditions]
    if low_confidence is not None:
        tests.append(F.when(low_confidence, F.lit("low_confidence_label")))
    return F.array_compact(F.array(*tests))


def canonical_scene(category: Column, name: Column, scan_name: str = "Scan, frame, and capture") -> Column:
    """Task categories of all versions to today's scenes; null where there is none."""
    return F.when(category.isin("I0", "I1", "I2", "I3", "I4", "I5"), category).when((category == "I6") & ~name.eqNullSafe(F.lit(scan_name)), "I6").when(category == "I7", "I6")
