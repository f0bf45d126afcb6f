"""Capture trees as a data source of Spark, for batch and stream reads.

    capture_source.register(spark)
    spark.read.format("capture_tree").load(root).where("device = '...' AND day >= '2026-01-01'")
    spark.readStream.format("capture_tree").option("settle", "2").load(root)

A tree holds `devices/<device>/<day>/<batch>.json`. Rows are (device, day, path, bytes, modified, raw). Filters on device and
day are pushed to the source, so only the folders that pass are listed, and nothing of the others is read; a read that
does not name `raw` (`load` with a schema of its own) opens no file. The driver lists the two levels of folders,
executors list and read the files in them; a device's days are split over partitions, so one device that holds most of
the tree does not stand in one task. Sidecars (`*.meta.json`) and category views are skipped.

A stream's offset is a moment: a micro-batch holds the files that were written after the last moment and up to the next,
which lies `settle` seconds behind the clock, so files that are still being written wait. A restarted query goes on from
its checkpoint's moment and reads each file once; nothing but the moment has to be kept, however large the tree.

Files are read through pyarrow's file systems (local paths, s3, gs, hdfs). `read_tree` parses the documents on the JVM, with
the columns and the required-key gate of `batches.read_batches`.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "device string, day string, path string, bytes bigint, modified bigint, raw string"

#: Partitions that a read is dealt to.
PARTITIONS = 64

TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class Folders(InputPartition):
    """Folders (device, day, path) of which one task reads the files written after `low` and up to `high` (nanoseconds)."""

    folders: list[tuple[str, str, str]]
    low: int = -1
    high: int = 1 << 62


def _store(root: str):
    """(file system, path) of a tree's root."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = root[5:] if root.startswith("file:///") or not root.startswith("file://") else root[7:]
        root = "/" + root.lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _below(store, path: str) -> list[tuple[str, str]]:
    """(name, path) of the folders in a folder, in order."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((i.base_name, i.path) for i in found if i.type == fs.FileType.Directory)


class Tree:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.names = schema.names
        self.parts = int(options.get("partitions", PARTITIONS))
        self.tests: list[tuple[str, type, object]] = []

    def passes(self, column: str, value: str) -> bool:
        return all(TESTS[kind](value, bound) for name, kind, bound in self.tests if name == column)

    def folders(self) -> list[tuple[str, str, str]]:
        """The folders that the filters leave; of devices that fail not even the days are listed."""
        store, root = _store(self.root)
        devices = [d for d in _below(store, f"{root}/devices") if self.passes("device", d[0])]
        return [(device, day, path) for device, at in devices for day, path in _below(store, at) if self.passes("day", day)]

    def dealt(self, low: int = -1, high: int = 1 << 62) -> list[Folders]:
        folders = self.folders()
        n = min(self.parts, len(folders))
        return [Folders(folders[i::n], low, high) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = _store(self.root)
        for device, day, folder in partition.folders:
            for info in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
                if info.type != fs.FileType.File or not info.base_name.endswith(".json") or info.base_name.endswith(".meta.json") or not partition.low < info.mtime_ns <= partition.high:
                    continue
                row = {"device": device, "day": day, "path": info.path, "bytes": info.size, "modified": info.mtime_ns // 1_000_000}
                if "raw" in self.names:
                    with store.open_input_stream(info.path) as f:
                        row["raw"] = f.read().decode("utf-8", "replace")
                yield tuple(row[n] for n in self.names)


class TreeReader(Tree, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the comparisons of device and day with values; Spark keeps the others."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if type(f) in TESTS and name in (("device",), ("day",)):
                self.tests.append((name[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.dealt() or [Folders([])]


class TreeStream(Tree, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.settle = float(options.get("settle", 2))
        self.tests = [(c, kind, options[f"{o}{c}"]) for c in ("device", "day") for o, kind in (("", EqualTo), ("min", GreaterThanOrEqual)) if f"{o}{c}" in options]

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.dealt(start["until"], end["until"]) if start["until"] < end["until"] else []

    def commit(self, end: dict) -> None:
        pass


class CaptureTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(schema, self.options)

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureTree)


def read_tree(spark: SparkSession, root: str, strict: bool = False, stream: bool = False, **options: str) -> DataFrame:
    """One row per batch document of a tree, as `batches.read_batches` gives them, with the device and day of its folder:
    a filter on those reads their folders only."""
    from .batches import parsed

    register(spark)
    reader = (spark.readStream if stream else spark.read).format("capture_tree").options(**options)
    return parsed(reader.load(root).selectExpr("device AS folder_device", "day AS folder_day", "raw"), strict)
