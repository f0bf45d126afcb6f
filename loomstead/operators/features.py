"""Features of windows: moments, crossings, spectra, orientation, event mix, structure of node lists.

Aggregates are plain columns for groupBy().agg(), so a whole feature table is one partial and one final
aggregation on the window's key. Only the spectrum needs numpy; it runs as a grouped Arrow aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, guarded_kurtosis, guarded_skew


def time_stats(x: str, prefix: str) -> list[Column]:
    """Mean, population std, min, max, rms, energy, skewness, kurtosis; 0 where a window has no values."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(f"{prefix}_{name}")
    square = F.avg(F.col(x) * F.col(x))
    return [
        zero(F.avg(x), "mean"), zero(F.stddev_pop(x), "std"), zero(F.min(x), "min"), zero(F.max(x), "max"), zero(F.sqrt(square), "rms"), zero(square, "energy"),
        guarded_skew(x).alias(f"{prefix}_skew"), guarded_kurtosis(x).alias(f"{prefix}_kurt"),
    ]


def crossings_and_jerk(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Per group: zcr (share of neighbours on different sides of the mean) and jerk (mean squared step). Both means sum
    in the rows' order, so the same rows give the same bits however they arrive."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sided = df.withColumn("_side", (F.col(x) - F.avg(x).over(whole)) < 0)
    steps = sided.withColumn("_turn", (F.col("_side") != F.lag("_side").over(ordered)).cast("double")).withColumn("_step", F.col(x) - F.lag(x).over(ordered))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("_turn"), F.lit(0.0)).alias("zcr"), F.coalesce(F.avg(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("jerk"))


def sampling_rate(df: DataFrame, keys: list[str], time: str, unit: float, default: float = 100.0) -> DataFrame:
    """Per group: unit over the median positive step of its sorted times; the default where there is none."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.lit(unit) / F.median(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(default)).alias("rate"))


def orientation(x: str, y: str, z: str) -> list[Column]:
    """Pitch and roll (mean, population std) and whether the mean lies more along x than y."""
    pitch, roll = F.atan2(-F.col(x), F.sqrt(F.col(y) * F.col(y) + F.col(z) * F.col(z))), F.atan2(F.col(y), F.col(z))
    return [
        F.avg(pitch).alias("pitch_mean"), F.stddev_pop(pitch).alias("pitch_std"), F.avg(roll).alias("roll_mean"), F.stddev_pop(roll).alias("roll_std"),
        (F.abs(F.avg(x)) > F.abs(F.avg(y))).cast("double").alias("landscape"),
    ]


def heading_stability(x: str, y: str) -> Column:
    h = F.atan2(F.col(y), F.col(x))
    return F.sqrt(F.pow(F.avg(F.cos(h)), 2) + F.pow(F.avg(F.sin(h)), 2)).alias("heading_stability")


def motion_bins(x: Column, low: float = 0.1, high: float = 0.5) -> list[Column]:
    """Shares of rows below low, from low to below high, from high on, and the number above high."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return [
        share(x < low).alias("motion_low"), share((x >= low) & (x < high)).alias("motion_mid"), share(x >= high).alias("motion_high"), F.count_if(x > high).alias("bursts"),
    ]


def positional_corr(df: DataFrame, keys: list[str], channel: str, order: list[str], value: str, a: str, b: str) -> DataFrame:
    """Per group: correlation of channels a and b matched by position, over the shorter of the two."""
    numbered = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, channel).orderBy(*order)))
    wide = numbered.groupBy(*keys, "_pos").agg(F.max(F.when(F.col(channel) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(channel) == b, F.col(value))).alias("_b"))
    both = wide.where("_a IS NOT NULL AND _b IS NOT NULL")
    return both.groupBy(*keys).agg(guarded_corr("_a", "_b").alias("corr"))


def event_mix(df: DataFrame, keys: list[str], kind: str, kinds: list[str], per: float) -> DataFrame:
    """Per group: a count of each kind, the rate of all events and the entropy (natural log) over all kinds."""
    counts = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    entropy = F.ln(n) - F.sum(F.col("_n") * F.ln("_n")) / n
    return counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("_n"))), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in kinds], (n / F.lit(max(1e-9, per))).alias("rate"), entropy.alias("entropy"))


SPECTRUM = ["domfreq", "speccentroid", "specentropy", "band0_3", "band3_8", "band8_15"]


def spectrum_of(values: np.ndarray, rate: float) -> list[float]:
    """Dominant frequency, centroid, entropy and shares of three bands of the mean-free power spectrum."""
    n = len(values)
    if n < 2:
        return [0.0] * 6
    power = np.abs(np.fft.rfft(values - values.mean())) ** 2
    freq = np.fft.rfftfreq(n, 1.0 / rate)
    total = power.sum()
    if total < 1e-12:
        return [0.0] * 6
    p = power / total
    some = p[p > 0]
    bands = [float(p[(freq >= a) & (freq < b)].sum()) for a, b in ((0, 3), (3, 8), (8, 15))]
    # powers that differ by rounding only are equal, and the lowest of equal frequencies counts
    return [float(freq[int(np.round(p, 9).argmax())]), float((freq * p).sum()), float(-(some * np.log(some)).sum()), *bands]


def spectra(df: DataFrame, keys: list[str], order: list[str], x: str, rate: float) -> DataFrame:
    """Per group: the SPECTRUM columns. Windows are short (bounded by size times rate), so their values travel as arrays."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(x).alias("_x")))).alias("_rows"))
    values = F.transform("_rows", lambda r: r["_x"].cast("double"))

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([spectrum_of(np.asarray(v.values.to_numpy(zero_copy_only=False), float), rate) for v in column], pa.list_(pa.float64()))

    out = packed.withColumn("_s", run(values))
    return out.select(*keys, *[F.col("_s")[i].alias(name) for i, name in enumerate(SPECTRUM)])


#: Class names to buckets: the first fragment found wins (fixed values).
CLASS_BUCKETS = [("edit", "edit"), ("recycler", "list"), ("listview", "list"), ("gridview", "list"), ("switch", "switch"), ("checkbox", "switch"), ("radio", "switch"), ("seekbar", "switch"), ("spinner", "switch"), ("webview", "webview"), ("scrollview", "webview"), ("surface", "surface"), ("texture", "surface"), ("button", "button"), ("text", "text")]


def class_bucket(name: Column, table: list[tuple[str, str]] = CLASS_BUCKETS) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for part, bucket in table:
        out = F.when(lowered.contains(part), bucket) if out is None else out.when(lowered.contains(part), bucket)
    return out.otherwise("other")


def structural_hash(lines: Column) -> Column:
    """The first 32 bits of the SHA-256 of an array of lines, as a number."""
    return F.conv(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 8), 16, 10).cast("bigint")


#: Node bounds from this size on are sentinels, not coordinates (fixed value).
SENTINEL = 89_478_485


def valid_bounds(nodes: Column) -> Column:
    """The bounds (structs of left, top, right, bottom) of nodes that have real ones: no sentinel, positive extent. A
    side that is missing counts as 0."""
    sides = ["left", "top", "right", "bottom"]
    filled = F.transform(F.filter(nodes, lambda n: n["bounds_grid"].isNotNull()), lambda n: F.struct(*[F.coalesce(n["bounds_grid"][s], F.lit(0)).alias(s) for s in sides], n["class_name"].alias("class_name")))
    fine = lambda v: F.abs(v) < SENTINEL
    return F.filter(filled, lambda b: fine(b["left"]) & fine(b["top"]) & fine(b["right"]) & fine(b["bottom"]) & (b["right"] > b["left"]) & (b["bottom"] > b["top"]))


def screen_extent(boxes: Column) -> Column:
    """Area of the box around all boxes, 0 without any."""
    side = lambda f, agg: agg(F.transform(boxes, lambda b: b[f]))
    return F.coalesce((side("right", F.array_max) - side("left", F.array_min)) * (side("bottom", F.array_max) - side("top", F.array_min)), F.lit(0)).cast("double")


def relative_area(box: Column, extent: Column) -> Column:
    return F.least(F.lit(1.0), F.when(extent > 0, (box["right"] - box["left"]) * (box["bottom"] - box["top"]) / extent).otherwise(0.0))


def occupancy(nodes: Column) -> Column:
    """Sum of the nodes' areas relative to their own extent (over 1 where they nest)."""
    boxes = valid_bounds(nodes)
    extent = screen_extent(boxes)
    return F.aggregate(F.transform(boxes, lambda b: relative_area(b, extent)), F.lit(0.0), lambda s, x: s + x)


def in_bucket(bucket: str):
    """Predicate over node structs. (A lambda with a second argument would be given the index.)"""
    return lambda x: class_bucket(x["class_name"]) == bucket


def node_features(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Adds the ui_* columns of one node list (array of node structs): counts, ratios, class buckets, occupancy."""
    n = F.size(F.coalesce(F.col(nodes), F.array().cast(df.schema[nodes].dataType)))
    count = lambda test: F.size(F.filter(nodes, test)).cast("double")
    flag = lambda f: count(lambda x: F.coalesce(x[f], F.lit(False)))
    out = df.withColumn("ui_node_count", n.cast("double"))
    out = out.withColumn("ui_max_depth", F.coalesce(F.array_max(F.transform(nodes, lambda x: x["depth"])), F.lit(0)).cast("double"))
    for f in ("clickable", "editable", "scrollable", "checked", "selected"):
        out = out.withColumn(f"ui_{f}_count", flag(f))
    out = out.withColumn("ui_focusable_count", flag("focused"))
    for b in ("webview", "list", "switch", "edit"):
        out = out.withColumn(f"_{b}", count(in_bucket(b)))
    out = out.withColumn("ui_webview", (F.col("_webview") > 0).cast("double")).withColumn("ui_list", (F.col("_list") > 0).cast("double"))
    out = out.withColumn("ui_form_like_control_count", F.col("_switch") + F.col("_edit"))
    out = out.withColumn("_boxes", valid_bounds(F.col(nodes))).withColumn("_extent", screen_extent(F.col("_boxes")))
    boxes, area = F.col("_boxes"), lambda b: relative_area(b, F.col("_extent"))
    out = out.withColumn("ui_bounds_occupancy", F.least(F.lit(1.0), F.aggregate(F.transform(boxes, area), F.lit(0.0), lambda s, x: s + x)))
    surface = F.exists(boxes, lambda x: F.lower(x["class_name"]).rlike("surface|texture|video|canvas") & (area(x) > 0.5))
    out = out.withColumn("ui_surface_like", F.coalesce(surface, F.lit(False)).cast("double"))
    ratio = lambda c: F.col(c) / F.greatest(F.lit(1.0), F.col("ui_node_count"))
    out = out.withColumn("ui_editable_ratio", ratio("ui_editable_count")).withColumn("ui_scrollable_ratio", ratio("ui_scrollable_count"))
    return out.drop("_webview", "_list", "_switch", "_edit", "_extent", "_boxes")
