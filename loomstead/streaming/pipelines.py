"""Structured Streaming forms: envelope ingest with fan-out to tables, live sessions, windows and detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.ingest import duplicates, quarantine_record, rated, status_of

KEY = ["device_id", "day", "batch_id"]

#: Fields of the envelope that a stored batch keeps.
ENVELOPE_FIELDS = ["algorithm", "payload_sha256_hex", "rule_version", "rule_hash", "created_at_wall_millis"]

#: Reasons for which a document goes to quarantine: it could be read, but breaks the contract.
QUARANTINED = ["schema_validation_failed", "envelope_batch_device_id_mismatch", "envelope_batch_id_mismatch"]


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def judged_with_table(all_: DataFrame, number: int, root: str) -> DataFrame:
    """Outcomes of a micro-batch's rows, against the stored keys of the micro-batch's own days."""
    spark = all_.sparkSession
    good = duplicates(all_.where("reason IS NULL"), KEY, ["created_at_wall_millis", "content"], "content")
    if _exists(spark, f"{root}/batches"):
        days = F.broadcast(all_.where("reason IS NULL").select("day").distinct())  # a micro-batch spans few days
        held = spark.read.parquet(f"{root}/batches").where(F.col("micro") != number).withColumn("day", F.col("day").cast("string"))
        held = held.join(days, "day", "left_semi").select(*KEY, F.col("content").alias("held"))
        good = good.join(held, KEY, "left")
        good = good.withColumn("outcome", F.when(F.col("held").isNull(), F.col("outcome")).when(F.col("held") == F.col("content"), "duplicate").otherwise("conflict")).drop("held")
    return good.unionByName(all_.where("reason IS NOT NULL").withColumn("outcome", F.lit("rejected")))


def with_request(rows: DataFrame) -> DataFrame:
    """Adds request_id and the payload's sizes to rated envelopes."""
    request = F.sha2(F.concat_ws(":", "payload_sha256_hex", "created_at_wall_millis", "device_id", "batch_id"), 256)
    return rows.withColumns({"request_id": request, "compressed_size_bytes": F.length("packed").cast("bigint"), "decompressed_size_bytes": F.octet_length("plain").cast("bigint")})


def write_outcomes(judged: DataFrame, number: int, root: str) -> None:
    """The tables below `root` from the judged rows of a micro-batch; it is written over on a replay."""
    prefix = F.left("device_id", F.lit(8))
    put = lambda df, name, **by: df.write.mode("overwrite").parquet(f"{root}/{name}/micro={number}", **by)
    reason = F.when(F.col("outcome") == "conflict", "duplicate_batch_id_conflict").otherwise(F.col("reason"))
    rows = judged.withColumn("reason", reason).persist()
    try:
        failed, stored = rows.where("reason IS NOT NULL"), rows.where("outcome = 'stored'")
        now = F.unix_millis(F.current_timestamp()).alias("ingested_at_wall_millis")
        category = F.get_json_object("plain", "$.task_category").alias("task_category")
        put(failed.select("request_id", "reason", status_of("reason").alias("status"), prefix.alias("device_prefix"), "batch_id"), "errors")
        quarantined = failed.where(F.col("reason").isin(QUARANTINED)).select("request_id", "reason", "plain")
        put(quarantine_record(quarantined, "plain"), "quarantine")
        put(stored.select("device_id").distinct().withColumn("device_id_prefix", prefix), "idx_devices")
        put(stored.select("device_id", prefix.alias("device_id_prefix"), "batch_id", "day", F.get_json_object("plain", "$.collection_source").alias("collection_source"), category), "idx_batches", partitionBy="task_category")
        put(rows.select("request_id", F.coalesce("reason", "outcome").alias("event"), status_of("reason").alias("status")), "log")
        # what a sidecar holds: the envelope's own fields, sizes, the time of ingest, the result of the checks
        put(stored.select(*KEY, "content", "plain", "request_id", now, *ENVELOPE_FIELDS, "compressed_size_bytes", "decompressed_size_bytes", F.lit("ok").alias("schema_validation_result")), "batches", partitionBy="day")
    finally:
        rows.unpersist()


def fan_out(micro: DataFrame, number: int, batch_schema: str, root: str, checks=None) -> None:
    """One micro-batch of envelopes into the tables below `root`: batches (with what a sidecar holds), idx_devices,
    idx_batches, errors, quarantine, log. Each table has a folder of the micro-batch, written over on a replay, so a
    replay leaves every table as it was. Stored keys are read for the micro-batch's own days only."""
    all_ = with_request(rated(micro, batch_schema, checks)).persist()
    try:
        write_outcomes(judged_with_table(all_, number, root), number, root)
    finally:
        all_.unpersist()


def numbers_of(checkpoint: str) -> int:
    """Where the numbers of a checkpoint's micro-batches begin, so that two streams share a root."""
    from hashlib import sha256

    return int(sha256(checkpoint.encode()).hexdigest()[:6], 16) << 24


def ingest_envelopes(envelopes: DataFrame, batch_schema: str, checks, root: str, checkpoint: str):
    """Start a query over a stream of envelopes whose micro-batches fan out to the tables below `root`.

    `checks` is a boolean column over the parsed struct `batch` (None: the whole contract). A batch's key is device,
    UTC day of its start and id; the first arrival stays, one of the same canonical text adds nothing, another one is
    a conflict. `keyed_ingest` keeps the keys in state instead of reading them from the stored table.
    """
    offset = numbers_of(checkpoint)
    return envelopes.writeStream.foreachBatch(lambda micro, n: fan_out(micro, offset + n, batch_schema, root, checks)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counters(log: DataFrame) -> DataFrame:
    """(event, status, n) of the log table: what a metrics page counts."""
    return log.groupBy("event", "status").agg(F.count(F.lit(1)).alias("n"))


def _whole(frames: Iterator[pd.DataFrame], at: str) -> pd.DataFrame:
    """All rows of a key in one micro-batch, in time order: a key's rows may come in several frames."""
    return pd.concat(list(frames), ignore_index=True).sort_values(at, kind="stable", ignore_index=True)


def live_detection(scores: DataFrame, key: str, at: str, score: str, threshold: float, k: int, n: int, alpha: float = 0.5) -> DataFrame:
    """A stream of (key, at, alarm, ewma_alarm) from a stream of scores: at least k rejects in the last n, and the
    average e = alpha r + (1 - alpha) e over 0.5. The state of a key is its last n - 1 rejects and e."""

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent, e = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        pdf = _whole(frames, at)
        rejects = (pdf[score] < threshold).to_numpy(int)
        joined = np.concatenate((np.array(recent, int), rejects))
        sums = np.concatenate(([0], np.cumsum(joined)))
        ends = np.arange(len(recent), len(joined)) + 1
        alarms = sums[ends] - sums[np.maximum(ends - n, 0)] >= k
        averages = []
        for r in rejects.tolist():
            e = alpha * r + (1 - alpha) * e
            averages.append(e > 0.5)
        state.update((joined[len(joined) - min(n - 1, len(joined)) :].tolist(), e))
        yield pd.DataFrame({key: keys[0], at: pdf[at], "alarm": alarms, "ewma_alarm": averages})

    kind = dict(scores.dtypes)
    out = f"{key} {kind[key]}, {at} {kind[at]}, alarm boolean, ewma_alarm boolean"
    return scores.select(key, at, score).groupBy(key).applyInPandasWithState(step, out, "recent array<int>, e double", "append", GroupStateTimeout.NoTimeout)


def live_windows(samples: DataFrame, key: str, at: str, gap: int, size: int, stride: int) -> DataFrame:
    """A stream of (key, at, segment, rel, first_window, last_window): sessions part where samples are more than `gap`
    apart, and windows of `size` every `stride` run from a session's first sample. The state of a key is the number,
    start and last time of its session, whatever the stream's length; late samples count to the session that is open."""

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = _whole(frames, at)
        t = pdf[at].to_numpy(np.int64)
        segment, start, last = state.get if state.exists else (0, int(t[0]), int(t[0]))
        breaks = np.diff(np.concatenate(([last], t))) > gap
        segments = segment + np.cumsum(breaks)
        starts = np.where(breaks, t, np.int64(start))
        opened = np.maximum.accumulate(np.where(breaks, np.arange(len(t)), -1))
        starts = np.where(opened >= 0, t[np.maximum(opened, 0)], np.int64(start))
        rel = np.maximum(t - starts, 0)
        state.update((int(segments[-1]), int(starts[-1]), int(max(last, t[-1]))))
        yield pd.DataFrame({key: keys[0], at: t, "segment": segments, "rel": rel, "first_window": np.maximum(0, (rel - size) // stride + 1), "last_window": rel // stride})

    kind = dict(samples.dtypes)
    out = f"{key} {kind[key]}, {at} bigint, segment bigint, rel bigint, first_window bigint, last_window bigint"
    return samples.select(key, F.col(at).cast("bigint").alias(at)).groupBy(key).applyInPandasWithState(step, out, "segment bigint, start bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts by kind in event-time windows; rows later than the watermark drop out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), kind).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Rows by event-time session of a key; rows later than the watermark drop out."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
