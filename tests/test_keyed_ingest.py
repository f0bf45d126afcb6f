"""Ingest with keys in state: late, equal and conflicting arrivals over micro-batches, restarts, old days, counters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomstead.streaming import keyed_ingest as K
from loomstead.streaming.pipelines import ingest_envelopes, outcome_counters
from test_rules_and_scores import envelope

INNER = "device_id string, batch_id string, started_at_wall_millis bigint, x bigint"
START = 1_710_000_000_000


def text(batch, x, start=START, device="a" * 64):
    return json.dumps({"device_id": device, "batch_id": f"00000000-0000-4000-8000-{batch:012d}", "started_at_wall_millis": start, "x": x}).encode()


def arrival(batch, x, created, start=START, device="a" * 64):
    return envelope(text(batch, x, start, device)) | {"batch_id": f"00000000-0000-4000-8000-{batch:012d}", "created_at_wall_millis": created}


def put(folder, number, rows):
    (folder / "in").mkdir(parents=True, exist_ok=True)
    path = folder / "in" / f"{number:03d}.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, start, **options):
    schema = "algorithm string, batch_id string, created_at_wall_millis bigint, device_id string, payload_base64 string, payload_sha256_hex string, rule_hash string, rule_version string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = start(stream, INNER, F.col("batch.x").isNotNull(), str(folder / "out"), str(folder / "check"), **options)
    assert query.awaitTermination(200)


def outcomes(spark, folder):
    return {(r.event, r.n) for r in outcome_counters(spark.read.parquet(str(folder / "out/log"))).collect()}


def stored(spark, folder):
    return sorted((r.batch_id[-2:], str(r.day), json.loads(r.plain)["x"]) for r in spark.read.parquet(str(folder / "out/batches")).collect())


PARTS = [
    [arrival(1, 5, 200), arrival(1, 4, 100), arrival(1, 4, 300), arrival(2, 1, 100)],  # the earliest created of key 1 holds x = 4
    [arrival(1, 4, 50), arrival(2, 2, 400), arrival(3, 1, 10), arrival(3, 1, 10)],
    [arrival(2, 1, 500), arrival(1, 1, 600, START + 3 * K.DAY_MS), arrival(4, None, 1)],  # another day is another key; no x is rejected
]
WANTED = {("stored", 4), ("duplicate", 4), ("duplicate_batch_id_conflict", 2), ("schema_validation_failed", 1)}
KEPT = [("01", "2024-03-09", 4), ("01", "2024-03-12", 1), ("02", "2024-03-09", 1), ("03", "2024-03-09", 1)]


@pytest.mark.parametrize("keep_days", [36_500, 1])
def test_outcomes_with_state_and_with_the_table(spark, tmp_path, keep_days):
    """Days inside the state's reach are judged by it, older ones by the stored table, with the same result."""
    for i, part in enumerate(PARTS):
        put(tmp_path, i, part)
    run(spark, tmp_path, K.keyed_ingest, keep_days=keep_days)
    assert outcomes(spark, tmp_path) == WANTED and stored(spark, tmp_path) == KEPT


def test_a_restart_and_a_root_with_batches(spark, tmp_path):
    """The first part comes by the other ingest, the second by keyed state that begins with its table, the third after a restart."""
    put(tmp_path / "old", 0, PARTS[0])
    schema_of = lambda s, inner, checks, out, check: ingest_envelopes(s, inner, checks, str(tmp_path / "new/out"), check)
    run(spark, tmp_path / "old", schema_of)
    for i in (1, 2):
        put(tmp_path / "new", i, PARTS[i])
        run(spark, tmp_path / "new", K.keyed_ingest, keep_days=36_500)
    assert outcomes(spark, tmp_path / "new") == WANTED and stored(spark, tmp_path / "new") == KEPT


def test_counters_equal_the_log(spark, tmp_path):
    for i, part in enumerate(PARTS):
        put(tmp_path, i, part)
    listener = K.CounterTable(spark, str(tmp_path / "out"))
    spark.streams.addListener(listener)
    try:
        run(spark, tmp_path, K.keyed_ingest, keep_days=36_500)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    table = spark.read.parquet(str(tmp_path / "out/counters"))
    got = {(r.metric, r.label): r.n for r in K.counters(table).collect()}
    assert got["received", "envelopes"] == 11
    names = {"duplicate_batch_id_conflict": "conflict"}
    assert {(names.get(e, e), n) for e, n in outcomes(spark, tmp_path)} == {(label, n) for (m, label), n in got.items() if m == "outcomes" and n}
    steps = {r.le: r.n for r in K.latency_histogram(table).collect()}
    assert steps[None] == 11 and all(steps[b] == 0 for b in K.BUCKETS)  # made in 1970
    again = table.groupBy("query", "micro").count().count()
    for p in [p for p in (tmp_path / "out/counters").rglob("micro=*")][:1]:  # a replayed progress writes over its folder
        frame = spark.read.parquet(str(p)).toPandas()
        spark.createDataFrame(frame).write.mode("overwrite").parquet(str(p))
    assert spark.read.parquet(str(tmp_path / "out/counters")).groupBy("query", "micro").count().count() == again
