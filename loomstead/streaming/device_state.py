"""Keyed device state with timers: capture batches stream in, closed windows of closed or running sessions stream out.

`live_session_windows` is the streaming form of the window plan (`plans.sensor_windows.windowed_samples`): the same order,
session breaks, session axis and windows, whatever micro-batches the stream is cut into. A device's state is

* `pending` (map): batches that came but whose place in the device's order is not settled yet, by start and id. An
  event-time timer at a batch's start fires once the watermark has passed it, and no earlier batch can come any more;
* `clock` (value): what the next sample is compared with, a few scalars; it goes `forget` after the last sample;
* `session` (value): the open session's id, bounds, place on its axis and next window;
* `rows` (list): samples that windows not yet given out may hold, an entry for each batch.

A second timer closes a session when the watermark is further than the session gap behind its last sample: whatever
comes next would break it. So a session ends without another batch of its device, its last windows come out, and its
state goes. Memory of a device is bounded by one window of samples and by the batches inside the watermark's delay.

Rows behind the watermark are dropped by Spark, as in any stream; a batch that starts at or before it when it arrives
has missed its place and is left out as well. Where a device's clock returns to an earlier day after that day's session
was closed, the session's id comes again with windows numbered from 0 (the batch plan, which sees all, joins the two).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A sample as state holds it.
ROW = np.dtype([("ts", "i8"), ("wall", "i8"), ("pos", "i4"), ("kind", "S24"), ("x", "f8"), ("y", "f8"), ("z", "f8"), ("rel", "i8"), ("number", "i8")])

SAMPLE = "sensor_type string, timestamp_elapsed_nanos bigint, pos int, wall bigint, rel bigint, batch_order bigint, x double, y double, z double"
WINDOW = (
    "device_id string, session_id string, day string, app_package_name string, window_index bigint, k bigint, start_wall bigint, end_wall bigint, n_samples bigint, n_batches bigint, "
    "clock_backward boolean, time_gap boolean, samples array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in SAMPLE.split(", ")) + ">>"
)

CLOCK = "day string, segment bigint, number bigint, wall bigint, base bigint, batch string, uploaded string, app string"
SESSION = "id string, day string, app string, first_wall bigint, last_wall bigint, offset bigint, reach bigint, next_k bigint, next_index bigint, backward boolean, gap boolean"


def _days(wall: np.ndarray, zone: str) -> np.ndarray:
    """Calendar days of epoch milliseconds; a batch spans few, so few are formatted."""
    local = pd.to_datetime(wall, unit="ms", utc=True).tz_convert(zone).tz_localize(None)
    number = local.to_numpy().astype("datetime64[D]")
    return number.astype(str).astype(object)


class DeviceWindows(StatefulProcessor):
    """Settles a device's batches in order, and cuts them into sessions and windows."""

    def __init__(self, size: int, stride: int, gap_ms: int, zone: str, min_session_ms: float, guard: int, forget_ms: int) -> None:
        self.size, self.stride, self.gap_ms, self.zone, self.min_ms, self.guard, self.forget_ms = size, stride, gap_ms, zone, min_session_ms, guard, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "place string", "started bigint, batch string, base bigint, uploaded string, app string, samples binary")
        self.clock = handle.getValueState("clock", CLOCK)
        self.session = handle.getValueState("session", SESSION)
        self.rows = handle.getListState("rows", "samples binary")

    # what comes in waits for its place

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        timers = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.started <= mark:
                    continue
                found = np.zeros(len(r.ts), ROW)
                for name in ("ts", "wall", "x", "y", "z"):
                    found[name] = np.asarray(getattr(r, name), float if name in "xyz" else np.int64)
                found["kind"], found["pos"] = np.asarray(r.kind, "S24"), np.arange(len(found))
                base = int(found["ts"].min()) if r.base is None or r.base != r.base else int(r.base)
                self.pending.updateValue((f"{int(r.started):020d}:{r.batch_id}",), (int(r.started), r.batch_id, base if len(found) else 0, r.uploaded, r.app, found.tobytes()))
                timers.add(int(r.started))
        for at in timers:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        if self.pending.exists():
            for place in sorted(p[0] for p in self.pending.keys()):
                started, *batch = self.pending.getValue((place,))
                if started > mark:
                    break
                self._take(key[0], *batch, out)
                self.pending.removeKey((place,))
        if self.session.exists():
            last = self.session.get()[4]
            if mark > last + self.gap_ms:
                self._close(key[0], out)
            else:
                self.handle.registerTimer(last + self.gap_ms + 1)
        elif self.clock.exists():
            last = self.clock.get()[3]
            if mark > last + self.forget_ms:
                self.clock.clear()
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in WINDOW.split(", samples ")[0].split(", ")] + ["samples"])

    # a batch in its place

    def _take(self, device: str, batch: str, base: int, uploaded: str, app: str, data: bytes, out: list) -> None:
        rows = np.frombuffer(data, ROW).copy()
        if not len(rows):
            clock = self.clock.get() if self.clock.exists() else None
            if clock is not None:  # a batch without samples still has a number
                self.clock.update((*clock[:2], clock[2] + 1, *clock[3:]))
            return
        rows = rows[np.lexsort((rows["pos"], rows["kind"], rows["ts"]))]
        days = _days(rows["wall"], self.zone)
        day, segment, number, wall, last_base, last_batch, last_uploaded, last_app = self.clock.get() if self.clock.exists() else (None, -1, -1, int(rows["wall"][0]), base, batch, uploaded, app)
        number += 1
        rows["number"] = number
        gaps = np.diff(np.concatenate(([wall], rows["wall"]))) > self.gap_ms
        new_day = np.concatenate(([days[0] != day], days[1:] != days[:-1]))
        backward = batch != last_batch and base < last_base
        breaks = new_day | gaps
        breaks[0] |= backward or uploaded != last_uploaded or app != last_app
        cuts = np.flatnonzero(breaks).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            if a == b:
                continue
            if breaks[a]:
                if self.session.exists():
                    self._close(device, out)
                segment = 0 if new_day[a] else segment + 1
                day = days[a]
                self.session.update((f"{device}:{day}:{segment}", day, app, int(rows["wall"][a]), int(rows["wall"][a]), 0, 0, 0, 0, False, False))
            self._append(device, rows[a:b], bool(backward and a == 0), bool(gaps[a:b].any()), out)
        self.clock.update((day, segment, number, int(rows["wall"][-1]), base, batch, uploaded, app))

    def _append(self, device: str, rows: np.ndarray, backward: bool, gap: bool, out: list) -> None:
        sid, day, app, first, last, offset, reach, next_k, next_index, was_backward, was_gap = self.session.get()
        low, high = int(rows["ts"].min()), int(rows["ts"].max())
        rows["rel"] = rows["ts"] - low + offset
        first, last = min(first, int(rows["wall"].min())), max(last, int(rows["wall"].max()))
        state = (sid, day, app, first, last, offset + high - low + self.guard, offset + high - low, next_k, next_index, was_backward or backward, was_gap or gap)
        self.session.update(state)
        self.rows.appendValue((rows.tobytes(),))
        if last - first >= self.min_ms:
            # what comes later lies behind the guard, so windows that end before it are whole
            self._emit(device, (state[6] + self.guard - self.size) // self.stride, out)

    def _top(self, reach: int) -> int:
        return (reach + self.stride - self.size) // self.stride

    def _emit(self, device: str, upto: int, out: list) -> None:
        """Give out the windows up to number `upto`, and keep what later ones may hold."""
        sid, day, app, first, last, offset, reach, next_k, next_index, backward, gap = self.session.get()
        upto = min(upto, self._top(reach))
        if upto < next_k:
            return
        rows = np.concatenate([np.frombuffer(r[0], ROW) for r in self.rows.get()])
        low = np.maximum((rows["rel"] - self.size) // self.stride + 1, next_k)
        high = np.minimum(rows["rel"] // self.stride, upto)
        reps = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(rows)), reps)
        k = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(low, reps)
        by = np.argsort(k, kind="stable")
        row, k = row[by], k[by]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
            held = rows[row[a:b]]
            samples = [
                {"sensor_type": kind.decode(), "timestamp_elapsed_nanos": ts, "pos": pos, "wall": wall, "rel": rel, "batch_order": number, **{c: None if v != v else v for c, v in zip("xyz", xyz)}}
                for ts, wall, pos, kind, *xyz, rel, number in held.tolist()
            ]
            out.append((device, sid, day, app, next_index, int(k[a]), int(held["wall"].min()), int(held["wall"].max()) + 1, len(held), len(np.unique(held["number"])), backward, gap, samples))
            next_index += 1
        self.session.update((sid, day, app, first, last, offset, reach, upto + 1, next_index, backward, gap))
        keep = rows[rows["rel"] >= (upto + 1) * self.stride]
        self.rows.clear()
        if len(keep):
            self.rows.appendValue((keep.tobytes(),))

    def _close(self, device: str, out: list) -> None:
        state = self.session.get()
        if state[4] - state[3] >= self.min_ms:
            self._emit(device, self._top(state[6]), out)
        self.session.clear()
        self.rows.clear()
        self.handle.registerTimer(state[4] + self.forget_ms + 1)

    def close(self) -> None:
        pass


def live_session_windows(
    batches: DataFrame, size_s: float = 5.0, stride_s: float = 1.0, gap_min: float = 10.0, zone: str = "Asia/Shanghai", min_session_s: float = 5.0, late: str = "1 minute", guard: int = 10_000_000, forget_days: float = 7.0
) -> DataFrame:
    """A stream of windows (WINDOW) from a stream of capture batches; `late` is how far behind the newest batch's start
    another batch may come. Needs the RocksDB state store, which this sets for the session where another is set."""
    spark = batches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    sample = lambda c: F.transform("sensor_samples", lambda s: s[c])
    started = F.col("started_at_wall_millis")
    placed = batches.withColumn("_at", F.timestamp_millis(started)).withWatermark("_at", late)
    packed = placed.select(
        "_at", "device_id", "batch_id", started.alias("started"), F.col("base_elapsed_nanos").alias("base"), F.coalesce("session_id", F.lit("")).alias("uploaded"), F.coalesce("app_package_name", F.lit("")).alias("app"),
        sample("timestamp_elapsed_nanos").alias("ts"), sample("wall_time_estimated_millis").alias("wall"), F.transform("sensor_samples", lambda s: F.coalesce(s["sensor_type"], F.lit("unknown"))).alias("kind"), *[sample(c).alias(c) for c in "xyz"],
    )
    processor = DeviceWindows(round(size_s * 1e9), round(stride_s * 1e9), round(gap_min * 60_000), zone, min_session_s * 1000, guard, round(forget_days * 86_400_000))
    return packed.groupBy("device_id").transformWithStateInPandas(processor, outputStructType=WINDOW, outputMode="Append", timeMode="EventTime")


def window_samples(windows: DataFrame) -> DataFrame:
    """The rows that the batch plan's window features read, from the windows of the stream."""
    return windows.select("device_id", "session_id", "day", "app_package_name", "window_index", "k", F.explode("samples").alias("s")).select("device_id", "session_id", "day", "app_package_name", "window_index", "k", "s.*")
