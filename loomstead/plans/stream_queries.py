"""Queries over the event stream: order, gaps, sessions, windows, joins by time (survey rows W and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import local_day, wall_millis
from ..operators import timeline as T
from .catalog import register

HOUR = 3_600_000
GAP, SIZE, STRIDE, ZONE = 12 * HOUR, 24 * HOUR, 6 * HOUR, "Asia/Shanghai"

#: DuckDB forms of the steps below; each is a CTE on the one before.
EV = "ev AS (SELECT event_id, user_id AS device, epoch_us(ts) // 1000 AS wall, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type AS kind, value FROM events)"
MARK = f"""mk AS (SELECT *, row_number() OVER w = 1 AS first, coalesce(day <> lag(day) OVER w, true) AS new_day,
 coalesce(wall - lag(wall) OVER w > {GAP}, false) AS gap FROM ev WINDOW w AS (PARTITION BY device ORDER BY wall, event_id)),
bd AS (SELECT *, (new_day OR gap) AS boundary, sum(new_day::INT) OVER (PARTITION BY device ORDER BY wall, event_id) AS day_run FROM mk)"""
SESS = f"""{EV}, {MARK}, sess AS (SELECT *, (sum(boundary::INT) OVER (PARTITION BY device, day_run ORDER BY wall, event_id) - 1)::BIGINT AS segment FROM bd),
ss AS (SELECT *, concat(device, ':', day, ':', segment) AS session_id FROM sess)"""
AXIS = f"""{SESS}, ord AS (SELECT *, dense_rank() OVER (PARTITION BY device ORDER BY day) - 1 AS batch_order FROM ss),
rl AS (SELECT *, wall - min(wall) OVER (PARTITION BY device) AS rel FROM ord)"""
WIN = f"""{AXIS}, top AS (SELECT *, floor((max(rel) OVER (PARTITION BY device) + {STRIDE} - {SIZE}) / {STRIDE}.0)::BIGINT AS top FROM rl),
win AS (SELECT top.*, k FROM top, UNNEST(range(greatest(0, floor((rel - {SIZE}) / {STRIDE}.0)::BIGINT + 1), least(top.top, floor(rel / {STRIDE}.0)::BIGINT) + 1)) AS u(k)),
wi AS (SELECT *, dense_rank() OVER (PARTITION BY device ORDER BY k) - 1 AS window_index FROM win)"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wall = wall_millis("ts")
    return events.select("event_id", F.col("user_id").alias("device"), wall.alias("wall"), local_day(wall, ZONE).alias("day"), F.col("event_type").alias("kind"), "value")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = T.clock_gaps(stream(spark, sf_dir), "device", ["wall", "event_id"], "wall", GAP)
    return T.sessionize(gaps, "device", ["wall", "event_id"], "day", [F.col("time_gap")])


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by device in sliding windows of a day every six hours."""

    rel = sessions(spark, sf_dir).withColumn("rel", F.col("wall") - F.min("wall").over(Window.partitionBy("device")))
    return T.sliding_windows(rel, SIZE, STRIDE, keys=("device",))


@register("batch_order", "W1", f"WITH {EV} SELECT event_id, device, row_number() OVER (PARTITION BY device ORDER BY wall, event_id) - 1 AS batch_order FROM ev")
def batch_order(spark, sf_dir):
    return T.order_batches(stream(spark, sf_dir), "device", "wall", "event_id").select("event_id", "device", "batch_order")


@register("gap_annotation", "W2", f"WITH {EV}, g AS (SELECT *, coalesce(wall - lag(wall) OVER (PARTITION BY device ORDER BY wall, event_id), 0) AS wall_gap_ms FROM ev) SELECT event_id, wall_gap_ms, wall_gap_ms > {GAP} AS time_gap FROM g")
def gap_annotation(spark, sf_dir):
    return T.clock_gaps(stream(spark, sf_dir), "device", ["wall", "event_id"], "wall", GAP).select("event_id", "wall_gap_ms", "time_gap")


@register("clock_backward", "W2", f"""WITH {EV}, b AS (SELECT *, wall // 86400000 AS batch, value AS base FROM ev)
SELECT event_id, coalesce(batch <> lag(batch) OVER w AND base < lag(base) OVER w, false) AS clock_backward FROM b WINDOW w AS (PARTITION BY device ORDER BY wall, event_id)""")
def clock_backward(spark, sf_dir):
    b = stream(spark, sf_dir).withColumn("batch", F.expr("wall div 86400000"))
    return T.clock_gaps(b, "device", ["wall", "event_id"], "wall", GAP, "value", "batch").select("event_id", "clock_backward")


@register("sessionize_events", "W3 P6", f"WITH {SESS} SELECT event_id, boundary, segment, session_id FROM ss")
def sessionize_events(spark, sf_dir):
    return sessions(spark, sf_dir).select("event_id", "boundary", "segment", "session_id")


@register("session_summary", "W4", f"WITH {SESS} SELECT device, session_id, min(day) AS day_id, count(*) AS n_samples, min(wall) AS first_wall, max(wall) AS last_wall, count(DISTINCT kind) AS n_batches FROM ss GROUP BY device, session_id")
def session_summary(spark, sf_dir):
    return T.session_summary(sessions(spark, sf_dir), "device", "day", "wall", "kind")


@register("short_session_filter", "L1", f"WITH {SESS} SELECT event_id, session_id FROM ss QUALIFY (max(wall) OVER (PARTITION BY session_id) - min(wall) OVER (PARTITION BY session_id)) / 1000.0 >= 3600")
def short_session_filter(spark, sf_dir):
    return T.drop_short_sessions(sessions(spark, sf_dir), "wall", 3600.0).select("event_id", "session_id")


@register("session_relative_axis", "W5", f"""WITH {EV}, b AS (SELECT *, device || ':' || (wall // {7 * 24 * HOUR}) AS session_id, wall // {24 * HOUR} AS batch_order FROM ev),
sp AS (SELECT session_id, batch_order, min(wall) AS f, max(wall) - min(wall) AS s FROM b GROUP BY ALL),
o AS (SELECT *, coalesce(sum(s + 10) OVER (PARTITION BY session_id ORDER BY batch_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sp)
SELECT event_id, wall - f + off AS rel FROM b JOIN o USING (session_id, batch_order)""")
def session_relative_axis(spark, sf_dir):
    b = stream(spark, sf_dir).withColumn("session_id", F.expr(f"concat(device, ':', wall div {7 * 24 * HOUR})")).withColumn("batch_order", F.expr(f"wall div {24 * HOUR}"))
    return T.session_axis(b, "wall", 10).select("event_id", "rel")


@register("sliding_windows", "W6 S7", f"WITH {WIN} SELECT event_id, k, window_index FROM wi")
def sliding_windows(spark, sf_dir):
    return windows(spark, sf_dir).select("event_id", "k", "window_index")


@register("window_wall_bounds_mode", "W7 W8 W14", f"""WITH {WIN}, c AS (SELECT device, window_index, kind, count(*) AS n FROM wi GROUP BY ALL),
m AS (SELECT device, window_index, kind AS package_bucket FROM c QUALIFY row_number() OVER (PARTITION BY device, window_index ORDER BY n DESC, kind) = 1)
SELECT device, window_index, min(wall) AS start_wall, max(wall) + 1 AS end_wall, any_value(package_bucket) AS package_bucket, count(*) AS n_samples, count(DISTINCT batch_order) AS n_batches
FROM wi JOIN m USING (device, window_index) GROUP BY device, window_index""")
def window_wall_bounds_mode(spark, sf_dir):

    w = windows(spark, sf_dir).withColumn("batch_order", F.col("day"))
    return T.window_table(w, "wall", "kind", "batch_order", ("device", "window_index"))


RANGES = f"""WITH {WIN}, b AS (SELECT device, window_index, min(wall) AS start_wall, max(wall) + 1 AS end_wall FROM wi GROUP BY device, window_index)
SELECT b.device, b.window_index, ev.event_id FROM b JOIN ev ON ev.device = b.device AND ev.wall >= b.start_wall AND ev.wall < b.end_wall AND ev.kind IN ('click', 'view')"""


@register("window_event_range_join", "W9 W10 W11", RANGES)
def window_event_range_join(spark, sf_dir):
    bounds = windows(spark, sf_dir).groupBy("device", "window_index").agg(F.min("wall").alias("start_wall"), (F.max("wall") + 1).alias("end_wall"))
    events = stream(spark, sf_dir).where(F.col("kind").isin("click", "view")).select("device", "event_id", "wall")
    return T.range_attach(bounds, events, ["device"], "start_wall", "end_wall", "wall", 6 * HOUR).select("device", "window_index", "event_id")


@register("previous_state_carry", "W12", f"""WITH {EV} SELECT event_id, last_value(CASE WHEN kind = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY device ORDER BY wall, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ev""")
def previous_state_carry(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("seen", F.when(F.col("kind") == "purchase", F.col("value")))
    return T.carry_previous(e, ["device"], ["wall", "event_id"], "seen", "previous").select("event_id", "previous")


@register("session_flags", "W13", f"WITH {SESS} SELECT event_id, bool_or(gap) OVER (PARTITION BY session_id) AS any_gap FROM ss")
def session_flags(spark, sf_dir):

    return sessions(spark, sf_dir).select("event_id", F.bool_or("time_gap").over(Window.partitionBy("session_id")).alias("any_gap"))


@register("successor_link", "W15", f"WITH {SESS} SELECT event_id, lead(event_id) OVER (PARTITION BY session_id ORDER BY wall, event_id) AS next_row FROM ss")
def successor_link(spark, sf_dir):
    return T.successor(sessions(spark, sf_dir), ["session_id"], ["wall", "event_id"], "event_id").select("event_id", "next_row")


@register("asof_last_event", "2.14", f"""WITH {EV}, p AS (SELECT device, wall, event_id AS purchase_id, value AS amount FROM ev WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY device, wall ORDER BY event_id) = 1)
SELECT v.event_id, p.purchase_id, p.amount FROM (SELECT * FROM ev WHERE kind = 'view') v ASOF LEFT JOIN p ON v.device = p.device AND v.wall >= p.wall""")
def asof_last_event(spark, sf_dir):
    e = stream(spark, sf_dir)
    views = e.where("kind = 'view'").select("device", "wall", "event_id")
    bought = e.where("kind = 'purchase'").groupBy("device", "wall").agg(F.min_by("event_id", "event_id").alias("purchase_id"), F.min_by("value", "event_id").alias("amount"))
    return T.as_of(views, bought, ["device"], "wall", "wall", ["purchase_id", "amount"]).select("event_id", "purchase_id", "amount")
