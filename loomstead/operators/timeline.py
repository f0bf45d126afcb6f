"""Ordering, gaps, sessions, session axes and sliding windows of event and sample streams.

Every operator partitions by the stream's key (device or session) only; a chain of them on one key shares one
shuffle. None of them sorts or collects globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_batches(df: DataFrame, device: str, started: str, batch: str) -> DataFrame:
    """Adds batch_order: a batch's place in its device, by start and then id, from 0."""
    w = Window.partitionBy(device).orderBy(started, batch)
    return df.withColumn("batch_order", (F.row_number().over(w) - 1).cast("bigint"))


def clock_gaps(df: DataFrame, device: str, order: list[str], wall: str, max_gap_ms: int, base: str | None = None, batch: str | None = None) -> DataFrame:
    """Adds wall_gap_ms (0 in a device's first row), time_gap (gap over the bound) and clock_backward (a new batch
    whose base lies before the previous one's; false in the first row)."""
    w = Window.partitionBy(device).orderBy(*order)
    out = df.withColumn("wall_gap_ms", F.coalesce(F.col(wall) - F.lag(wall).over(w), F.lit(0))).withColumn("time_gap", F.col("wall_gap_ms") > max_gap_ms)
    if base and batch:
        back = (F.col(batch) != F.lag(batch).over(w)) & (F.col(base) < F.lag(base).over(w))
        out = out.withColumn("clock_backward", F.coalesce(back, F.lit(False)))
    return out


def sessionize(df: DataFrame, device: str, order: list[str], day: str, breaks: list[Column | str]) -> DataFrame:
    """Adds boundary, segment and session_id = device:day:segment.

    A row opens a session if it is its device's first, its day differs from the row before, or a column of
    `breaks` differs (names) or is true (boolean columns) there. Segments count from 0 within a run of equal
    days; when the clock returns to an earlier day its session ids come again, and those sessions merge.
    """
    w = Window.partitionBy(device).orderBy(*order)
    first = F.row_number().over(w) == 1
    new_day = F.coalesce(F.col(day) != F.lag(day).over(w), first)
    broken = new_day
    for b in breaks:
        changed = ~F.col(b).eqNullSafe(F.lag(b).over(w)) & ~first if isinstance(b, str) else b & ~first
        broken = broken | F.coalesce(changed, F.lit(False))
    marked = df.withColumn("boundary", broken).withColumn("_new_day", new_day)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_day_run", F.sum(F.col("_new_day").cast("bigint")).over(running))
    in_run = Window.partitionBy(device, "_day_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.withColumn("segment", F.sum(F.col("boundary").cast("bigint")).over(in_run) - 1)
    return out.withColumn("session_id", F.concat_ws(":", F.col(device).cast("string"), F.col(day), F.col("segment").cast("string"))).drop("_new_day", "_day_run")


def session_summary(df: DataFrame, device: str, day: str, wall: str, batch: str) -> DataFrame:
    return df.groupBy(device, "session_id").agg(
        F.min(day).alias("day_id"), F.count(F.lit(1)).alias("n_samples"), F.min(wall).alias("first_wall"), F.max(wall).alias("last_wall"), F.countDistinct(batch).alias("n_batches")
    )


def drop_short_sessions(df: DataFrame, wall: str, min_seconds: float) -> DataFrame:
    """Without the rows of sessions whose wall span is below min_seconds; a bound of 0 or less keeps all."""
    if min_seconds <= 0:
        return df
    w = Window.partitionBy("session_id")
    return df.withColumn("_span", (F.max(wall).over(w) - F.min(wall).over(w)) / 1000.0).where(F.col("_span") >= min_seconds).drop("_span")


def session_axis(df: DataFrame, time: str, guard: int, batch_order: str = "batch_order") -> DataFrame:
    """Adds rel: batches of a session laid end to end, each from 0, with `guard` between one and the next."""
    spans = df.groupBy("session_id", batch_order).agg(F.min(time).alias("_from"), (F.max(time) - F.min(time)).alias("_span"))
    before = Window.partitionBy("session_id").orderBy(batch_order).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum(F.col("_span") + guard).over(before), F.lit(0)))
    return df.join(spans.drop("_span"), ["session_id", batch_order]).withColumn("rel", F.col(time) - F.col("_from") + F.col("_offset")).drop("_from", "_offset")


def sliding_windows(df: DataFrame, size: int, stride: int, rel: str = "rel", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row per row and window that holds it: adds k (the window's step) and window_index (rank of the windows
    that hold anything, from 0). Windows start at k * stride while they end one stride past the last row at most."""
    if size <= 0 or stride <= 0:
        raise ValueError("window size and stride are positive")
    last = F.max(rel).over(Window.partitionBy(*keys))
    top = F.floor((last + stride - size) / stride).cast("bigint")
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(rel) - size) / stride).cast("bigint") + 1)
    hi = F.least(top, F.floor(F.col(rel) / stride).cast("bigint"))
    out = df.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return out.withColumn("window_index", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("k")) - 1).cast("bigint"))


def window_table(df: DataFrame, wall: str, package: str, batch: str, keys: tuple[str, ...] = ("session_id", "window_index")) -> DataFrame:
    """Per window: wall bounds [start_wall, end_wall), most frequent package (the smallest of equals), counts."""
    return df.groupBy(*keys).agg(
        F.min(wall).alias("start_wall"), (F.max(wall) + 1).alias("end_wall"), F.mode(package, True).alias("package_bucket"), F.count(F.lit(1)).alias("n_samples"), F.countDistinct(batch).alias("n_batches")
    )


def range_attach(windows: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, at: str, bucket: int) -> DataFrame:
    """Inner join of windows with the events whose `at` lies in [start, end): an equi-join on keys and time buckets,
    so each event meets only the windows near it."""
    spread = windows.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    placed = events.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return spread.join(placed, [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def carry_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last non-null `value` of an earlier row of the group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def successor(df: DataFrame, keys: list[str], order: list[str], row: str, name: str = "next_row") -> DataFrame:
    return df.withColumn(name, F.lead(row).over(Window.partitionBy(*keys).orderBy(*order)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """Left rows with the `values` of the latest right row of their keys at or before their time: one union, one
    shuffle, one window; no pair of rows is ever made."""
    packed = F.struct(F.col(right_at).alias("_at"), *values)
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), packed.alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select("_left.*", *[F.col(f"_right.{v}").alias(v) for v in values])
