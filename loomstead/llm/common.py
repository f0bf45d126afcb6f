"""Helpers shared by the corpus operators: reading, Arrow slicing, byte-level hashing.

Nothing here opens files itself: tables come through Spark's readers only, so any store
that Spark can read works. The numpy helpers see one bounded slice of texts at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass may hold (its int64 arrays take eight times as much).
SLICE_BYTES = 1 << 20

#: White space of the word rule `[^\x20\x09-\x0D]+` as a Java/RE2 character class.
SPACE_CLASS = "[ \\t-\\r]"

#: Odd multipliers of the polynomial and mixing hashes (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/loomstead"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a Parquet table in the shared folder and read it.

    A lost executor then costs only its running tasks, and what several consumers read is computed once.
    Columnar and compressed, it takes a fraction of what a checkpoint of the same rows would.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """Cut lineage by a table in buckets of `key`: a join by it leaves the rows where they lie and moves the other side only.

    There are as many buckets as a shuffle has partitions; a task writes its rows of each to a file of its own, by zstd. The
    table has a name only until it is read, so the catalog keeps none; its files go with `clear`.
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{_own_folder(spark)}/{name}")
    writer.bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has cut, once their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose `column` holds about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """int64 offsets of a string or binary column (nulls take no bytes)."""
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 data of all rows, int64 offsets from 0) of a string or binary column, without copying the data."""
    offsets = offsets_of(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, kept by the size rounded up."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _TABLES:
        if len(_TABLES) > 2:
            _TABLES.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _TABLES[size] = (_powers(size, BASE), _powers(size, inverse))
    return _TABLES[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(29)
    x = x * MIX2
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power, modulo 2^64; length n + 1."""
    powers, _ = _tables(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each span: equal bytes give equal hashes wherever they stand."""
    _, inverse = _tables(len(sums) - 1)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * MIX2)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word `[^\x20\x09-\x0D]+` of the rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(text) -> "F.Column":
    """Words of a text column as an array, by built-in functions; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")
