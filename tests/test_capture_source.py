"""The capture tree as a data source: pruning by folder, column pruning, stream offsets, agreement with the plain reader."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains
from pyspark.sql.types import StructType

from loomstead.sources import capture_source as C
from loomstead.sources.batches import read_batches
from loomstead.sources.synthetic import synthetic_batches


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    rows = synthetic_batches(spark, users=3, days=2, sessions=1, batches=2).withColumn("day", F.date_format(F.timestamp_millis("started_at_wall_millis"), "yyyy-MM-dd"))
    for r in rows.select("raw", "device_id", "batch_id", "day").collect():
        folder = root / "devices" / r.device_id / r.day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{r.batch_id}.json").write_text(r.raw)
        (folder / f"{r.batch_id}.meta.json").write_text("{}")
    (folder / "broken.json").write_text("{not json")
    (folder / "poor.json").write_text(json.dumps({"record_type": "collection"}))
    (root / "by_category").mkdir()
    return str(root)


def test_same_batches_as_the_plain_reader(spark, tree):
    mine, theirs = C.read_tree(spark, tree), read_batches(spark, tree)
    columns = [c for c in theirs.columns if c not in ("redaction_summary",)]
    plain = lambda d: sorted(r.j for r in d.select(F.to_json(F.struct(*columns)).alias("j")).collect())
    assert plain(mine) == plain(theirs) and len(plain(mine)) == 12
    assert mine.where("folder_device <> device_id").count() == 0
    with pytest.raises(Exception, match="lacks required keys"):
        C.read_tree(spark, tree, strict=True).select("batch_id").collect()


def files_of(reader):
    return [row for p in reader.partitions() for row in reader.read(p)]


def test_filters_prune_folders(spark, tree):
    whole = C.TreeReader(StructType.fromDDL(C.SCHEMA), {"path": tree})
    everything = files_of(whole)
    assert len(everything) == 14 and len(whole.partitions()) == 6
    device, days = everything[0][0], sorted({r[1] for r in everything})
    reader = C.TreeReader(StructType.fromDDL(C.SCHEMA), {"path": tree})
    left = list(reader.pushFilters([EqualTo(("device",), device), GreaterThanOrEqual(("day",), days[1]), StringContains(("path",), "x")]))
    assert [type(f) for f in left] == [StringContains]
    assert reader.folders() == [(device, days[1], f"{tree}/devices/{device}/{days[1]}")]
    assert {r[:2] for r in files_of(reader)} == {(device, days[1])}
    C.register(spark)
    df = spark.read.format("capture_tree").load(tree).where(F.col("device").isin(device) & (F.col("day") >= days[1]) & F.col("path").contains("json"))
    assert sorted(r.path for r in df.collect()) == sorted(r[2] for r in files_of(reader))
    assert df.rdd.getNumPartitions() == 1
    assert spark.read.format("capture_tree").load(tree + "/none").count() == 0


def test_no_file_is_opened_for_its_name(spark, tree, monkeypatch):
    reader = C.TreeReader(StructType.fromDDL("path string, bytes bigint"), {"path": tree})
    monkeypatch.setattr("builtins.open", None)
    rows = files_of(reader)
    monkeypatch.undo()
    assert len(rows) == 14 and all(os.path.getsize(p) == n for p, n in rows)
    C.register(spark)
    assert spark.read.format("capture_tree").schema("device string, bytes bigint").load(tree).groupBy("device").count().count() == 3


def test_a_stream_reads_each_file_once(spark, tree, tmp_path):
    root = tmp_path / "tree"
    source = files_of(C.TreeReader(StructType.fromDDL(C.SCHEMA), {"path": tree}))

    def put(rows):
        for r in rows:
            folder = root / "devices" / r[0] / r[1]
            folder.mkdir(parents=True, exist_ok=True)
            (folder / os.path.basename(r[2])).write_text(r[5])

    def run():
        C.register(spark)
        stream = spark.readStream.format("capture_tree").option("settle", "0").load(str(root)).select("path")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                query.processAllAvailable if False else None
                if len(seen()) >= expected:
                    break
                __import__("time").sleep(0.5)
        finally:
            query.stop()

    def seen():
        return [r.path for r in spark.read.schema("path string").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []

    expected = 6
    put(source[:6])
    run()
    assert len(seen()) == 6
    expected = len(source)
    put(source[6:])  # written while no query runs: the next one goes on from the checkpoint
    run()
    assert sorted(os.path.basename(p) for p in seen()) == sorted(os.path.basename(r[2]) for r in source)


def test_offsets(tree):
    stream = C.TreeStream(StructType.fromDDL(C.SCHEMA), {"path": tree, "settle": "0", "minday": "2024-03-10"})
    end = stream.latestOffset()
    first = [r for p in stream.partitions(stream.initialOffset(), end) for r in stream.read(p)]
    assert first and all(r[1] >= "2024-03-10" for r in first)
    assert [r for p in stream.partitions(end, stream.latestOffset()) for r in stream.read(p)] == []
    assert stream.partitions(end, end) == []
