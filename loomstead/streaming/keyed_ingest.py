"""Ingest whose keys live in state, and its counters: a micro-batch never reads the stored table for recent days.

`keyed_ingest` writes the tables of `pipelines.ingest_envelopes` with the same outcomes. The hash of a key's stored
content is a value in state, so an arrival is judged by one lookup, however much is stored. A key holds its UTC day,
which bounds the state: an entry goes `keep_days` after its day. Arrivals for older days are judged against the stored
table, their own days only, so nothing is forgotten. A root that holds batches already gives the state to begin with.

Of arrivals of one key in one micro-batch the earliest created is stored, of equal ones that of the least content. Until
that one is known the others wait without their texts.

`observe` counts each micro-batch while it is written, and `CounterTable` puts the counts into a table, one folder a
query and micro-batch that a replay writes over. Summing the table therefore counts every envelope once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.ingest import REASONS, rated
from .device_state import ROCKS
from .pipelines import ENVELOPE_FIELDS, KEY, _exists, judged_with_table, numbers_of, with_request, write_outcomes

DAY_MS = 86_400_000

#: Upper bounds of the latency histogram, in milliseconds from an envelope's making to its ingest.
BUCKETS = [100, 500, 1_000, 5_000, 10_000, 60_000, 600_000, 3_600_000]

#: Rows of an Arrow batch on the way to the state: a row holds a batch's text, half a megabyte as a rule.
ARROW_ROWS = 128

COLUMNS = {
    **dict.fromkeys(KEY, "string"), "reason": "string", "content": "string", "plain": "string", "request_id": "string",
    **dict.fromkeys(ENVELOPE_FIELDS, "string"), "created_at_wall_millis": "bigint", "compressed_size_bytes": "bigint", "decompressed_size_bytes": "bigint",
}
OUT = ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", outcome string"


class BatchKeys(StatefulProcessor):
    """Judges the arrivals of a key; rows with a reason pass as rejected, rows of old days without an outcome."""

    def __init__(self, keep_days: int) -> None:
        self.keep_ms = keep_days * DAY_MS

    def init(self, handle) -> None:
        # a day is at most one ahead of an arrival's time, or its key stands in `ahead`, so the entry outlives the day's stay
        self.held = handle.getValueState("held", "content string", self.keep_ms + 2 * DAY_MS)
        self.ahead = handle.getValueState("ahead", "content string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._hold(initialState["day"].iloc[0], initialState["content"].iloc[0], timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, content, waiting, best = timerValues.getCurrentProcessingTimeInMs(), None, [], None
        for state in (self.held, self.ahead):
            if content is None and state.exists():
                content = state.get()[0]
        for frame in rows:
            frame = frame[list(COLUMNS)]
            if frame["reason"].iloc[0] is not None:
                yield frame.assign(outcome="rejected")
            elif content is not None:
                yield self._judged(frame, content)
            elif self._start(frame["day"].iloc[0]) + self.keep_ms < now:
                yield frame.assign(outcome=None)
            else:
                frame = frame.sort_values(["created_at_wall_millis", "content"], kind="stable", ignore_index=True)
                first, rest = frame.iloc[:1], frame.iloc[1:]
                if best is not None:
                    first, later = (first, best) if self._place(first) < self._place(best) else (best, first)
                    rest = pd.concat([rest, later])
                best = first
                waiting.append(rest.assign(plain=None))
        if best is not None:
            content = best["content"].iloc[0]
            self._hold(best["day"].iloc[0], content, now)
            yield best.assign(outcome="stored")
            for frame in waiting:
                if len(frame):
                    yield self._judged(frame, content)

    def _hold(self, day: str, content: str, now: int) -> None:
        (self.ahead if self._start(day) > now + DAY_MS else self.held).update((content,))

    @staticmethod
    def _judged(frame: pd.DataFrame, content: str) -> pd.DataFrame:
        return frame.assign(outcome=(frame["content"] == content).map({True: "duplicate", False: "conflict"}))

    @staticmethod
    def _place(row: pd.DataFrame) -> tuple:
        return row["created_at_wall_millis"].iloc[0], row["content"].iloc[0]

    @staticmethod
    def _start(day: str) -> int:
        return int(pd.Timestamp(day).value // 1_000_000)

    def close(self) -> None:
        pass


def _key_of() -> Column:
    """One text a key; a rejected row has no key and stands under its request."""
    return F.when(F.col("reason").isNull(), F.concat_ws("/", *KEY)).otherwise(F.concat(F.lit("rejected/"), "request_id"))


def received_counts(rows: DataFrame) -> DataFrame:
    """Observes what came: envelopes, their bytes, and the latency histogram (cumulative, as its bounds say)."""
    late = F.unix_millis(F.current_timestamp()) - F.col("created_at_wall_millis")
    steps = [F.count_if(late <= b).alias(f"le_{b}") for b in BUCKETS]
    sizes = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("compressed_size_bytes", "decompressed_size_bytes")]
    return rows.observe("received", F.count(F.lit(1)).alias("envelopes"), *sizes, *steps)


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Observes what became of it: one count an outcome and a reason; `aged` are judged against the stored table."""
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "duplicate", "conflict")]
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return rows.observe("outcomes", *outcomes, F.count_if(F.col("outcome").isNull()).alias("aged"), *reasons)


class CounterTable(StreamingQueryListener):
    """Writes the observed counts of each micro-batch below `root`/counters as (metric, label, n)."""

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(name, label, int(n)) for name, row in p.observedMetrics.items() if name in ("received", "outcomes") for label, n in row.asDict().items() if n is not None]
        if rows:
            path = f"{self.root}/counters/query={p.id}/micro={p.batchId}"
            self.spark.createDataFrame(rows, "metric string, label string, n bigint").coalesce(1).write.mode("overwrite").parquet(path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counters(table: DataFrame) -> DataFrame:
    """(metric, label, n) over all micro-batches, the latency bounds left out."""
    return table.where(~F.col("label").startswith("le_")).groupBy("metric", "label").agg(F.sum("n").alias("n"))


def latency_histogram(table: DataFrame) -> DataFrame:
    """(le, n) of all micro-batches: envelopes ingested within `le` milliseconds; a null bound counts them all."""
    n = F.col("label")
    rows = table.where((F.col("metric") == "received") & (n.startswith("le_") | (n == "envelopes")))
    return rows.groupBy(F.when(n != "envelopes", F.substring_index(n, "_", -1)).cast("bigint").alias("le")).agg(F.sum("n").alias("n"))


def _finish(micro: DataFrame, number: int, root: str) -> None:
    """Judge what state could not, and write the tables."""
    micro = micro.persist()
    try:
        aged = micro.where("reason IS NULL AND outcome IS NULL")
        judged = micro.where("outcome IS NOT NULL")
        if not aged.isEmpty():
            judged = judged.unionByName(judged_with_table(aged.drop("outcome"), number, root))
        write_outcomes(judged, number, root)
    finally:
        micro.unpersist()


def keyed_ingest(envelopes: DataFrame, batch_schema: str, checks, root: str, checkpoint: str, keep_days: int = 30):
    """Start a query as `pipelines.ingest_envelopes` does, with the keys of the last `keep_days` days in state. Needs the
    RocksDB state store; the session's settings are as before once the query has begun."""
    spark, offset = envelopes.sparkSession, numbers_of(checkpoint)
    came = received_counts(with_request(rated(envelopes, batch_schema, checks)))
    keyed = came.withColumn("_key", _key_of()).select("_key", *[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])
    before = None
    if _exists(spark, f"{root}/batches"):
        stored = spark.read.parquet(f"{root}/batches").select(*[F.col(c).cast("string").alias(c) for c in (*KEY, "content")])
        recent = stored.where(F.col("day") >= F.date_format(F.date_sub(F.current_date(), keep_days + 1), "yyyy-MM-dd"))
        before = recent.select(F.concat_ws("/", *KEY).alias("_key"), "day", "content").groupBy("_key")
    # expiry goes by the clock, for which Spark would run empty micro-batches without an end
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)}
    had = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        judged = keyed.groupBy("_key").transformWithStateInPandas(BatchKeys(keep_days), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime", initialState=before)
        writer = outcome_counts(judged).writeStream.foreachBatch(lambda micro, n: _finish(micro, offset + n, root))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
