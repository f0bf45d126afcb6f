"""Suffix-array dedup (operator 4): remove every byte inside a long string that also starts elsewhere.

A suffix array of the whole corpus would have to move every position. Equal strings of `length` bytes hold
the same smallest K-byte hash (their minimizer), so only strings under a minimizer that occurs twice or
more can repeat. Each run of strings with one minimizer is cut out as a context (about 260 bytes for 58
strings), equal contexts are counted as one, and contexts of a minimizer meet in one block. A block is put
in order by two-stage suffix sorting (`suffix_sort`), and the common prefixes of neighbours tell which
strings occur twice, in another context or in the same. Spans go back to the documents by context.

Minimizers with more than HOT distinct contexts (where a frequent passage begins or ends) would make their block
grow with the corpus. Their contexts, each once however often it occurs, are cut into strings keyed by their own
128-bit hash, so that equal strings are counted before they move and unequal ones part; the strings are sorted in
blocks like contexts, and those that repeat are put together to stretches of their contexts again.

Defined results: a null text counts as empty and loses nothing; repeated rows are documents of their own,
so they repeat each other; overlapping strings count, and all strings are judged on the input; an empty
table gives an empty one; no column but key and text is read; a null key is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, offsets_of, prefix_sums, slices, span_hashes
from .suffix_sort import Block

#: Bytes of a string that must not repeat, bytes of the hashes whose smallest is a string's minimizer.
LENGTH, K = 200, 84

#: Distinct contexts of a minimizer beyond which its strings are sorted one by one, bytes of a sorted block.
HOT, BLOCK = 4096, 1 << 20

#: Bits of a position inside a numpy pass; its hashes keep the rest.
BITS = 23

#: Stands for a null key inside joins.
NO_KEY = -(1 << 63)


def _windows_min(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours."""
    n = len(values)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(hash, row, start, n, times): runs of n neighbouring strings of `length` bytes with one minimizer hash, which
    stands at `times` places in the run (in periodic text it comes again and again)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    at = np.arange(len(data) - k + 1)
    hashes = span_hashes(prefix_sums(data), at, at + k)
    low = np.uint64((1 << BITS) - 1)
    least = _windows_min((hashes & ~low) | at.astype(np.uint64), length - k + 1)
    begins = np.arange(len(least))
    row = np.searchsorted(offsets, begins, side="right") - 1
    inside = begins + length <= offsets[row + 1]
    begins, row, place = begins[inside], row[inside], (least[inside] & low).astype(np.int64)
    if not len(begins):
        return none, none, none, none, none
    opens = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    key = hashes[place[opens]]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[opens[1:]] != row[opens[:-1]]))))
    times = np.diff(np.append(first, len(opens)))
    opens = opens[first]
    counts = np.diff(np.append(opens, len(begins)))
    return key[first].view(np.int64), row[opens], begins[opens] - offsets[row[opens]], counts, times


def _runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, id, th, start, n, times) of every run of every document."""
    piece = 1 << (BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = bytes_of(part.column(2))
            # a text longer than a numpy pass is alone in its slice: cut it so that every string is in one piece
            for a in range(0, max(len(data), 1), piece):
                b = min(len(data), a + piece + length - 1)
                key, row, start, n, times = minimizer_runs(data[a:b], offsets if len(data) <= piece else np.array([0, b - a]), length, k)
                if len(key):
                    ids, th = (part.column(i).to_numpy()[row] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids, th, (start + a).astype(np.int32), n.astype(np.int32), times.astype(np.int32))], names=["key", "id", "th", "start", "n", "times"])

    return docs.select("id", "th", "text").mapInArrow(run, "key bigint, id bigint, th bigint, start int, n int, times int")


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(key, ch, lo, hi) from distinct (key, ch, times, context): the stretches of the context inside repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = bytes_of(rows.column(3))
            some, first, last = Block(data, offsets).repeated(length, rows.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(some)), rows.column(1).take(pa.array(some)), pa.array(first.astype(np.int32)), pa.array((last + length).astype(np.int32))],
                names=["key", "ch", "lo", "hi"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            ends = offsets_of(batch.column(3))
            cuts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, batch.num_rows)
            if held and held[-1].column(0)[-1].as_py() != key[0] and size >= BLOCK:
                yield from solve()
                held, size = [], 0
            start = 0
            for stop in cuts.tolist():  # a block ends only where a key ends
                if size + int(ends[stop] - ends[start]) >= BLOCK and stop < batch.num_rows:
                    held.append(batch.slice(start, stop - start))
                    yield from solve()
                    held, size, start = [], 0, stop
            held.append(batch.slice(start))
            size += int(ends[-1] - ends[start])
        yield from solve()

    near = contexts.repartition("key").sortWithinPartitions("key")
    return near.select("key", "ch", "times", "context").mapInArrow(run, "key bigint, ch bigint, lo int, hi int")


def _hot_repeats(many: DataFrame, few: DataFrame, length: int, hot: int) -> DataFrame:
    """(key, ch, lo, hi) of all contexts: `few` are those of minimizers with up to `hot` places, `many` the others."""
    many = cut(many)
    contexts = many.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where(f"contexts > {hot}").select("key")
    plain = _repeats(few.union(many.join(contexts, "key", "left_anti")), length)
    each = many.join(contexts, "key", "left_semi").select("*", F.explode(F.expr(f"sequence(0, length(context) - {length})")).alias("at"))
    each = each.select("key", "ch", "times", "at", F.expr(f"substring(context, at + 1, {length})").alias("string"))
    each = each.select("*", F.xxhash64("string").alias("h"), F.xxhash64(F.lit(length), "string").alias("g"))
    strings = each.groupBy("h", "g").agg(F.sum("times").alias("times"), F.first("string").alias("context"))
    twice = _repeats(strings.withColumnsRenamed({"h": "key", "g": "ch"}), length).select(F.col("key").alias("h"), F.col("ch").alias("g"))
    starts = each.select("key", "ch", "at", "h", "g").join(twice, ["h", "g"], "left_semi")
    order = Window.partitionBy("key", "ch").orderBy("at")
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) > length, F.lit(True)).cast("int")
    stretches = starts.select("key", "ch", "at", opens.alias("opens")).withColumn("stretch", F.sum("opens").over(order))
    merged = stretches.groupBy("key", "ch", "stretch").agg(F.min("at").alias("lo"), (F.max("at") + length).alias("hi"))
    return plain.union(merged.select("key", "ch", F.col("lo").cast("int"), F.col("hi").cast("int")))


def _finish(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cut the spans out of every text."""
    schema = f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = bytes_of(part.column(1))
            packed, bounds = part.column(2).values.to_numpy(), part.column(2).offsets.to_numpy()
            out = []
            for i in range(part.num_rows):
                body = data[offsets[i] : offsets[i + 1]]
                spans = np.sort(packed[bounds[i] : bounds[i + 1]])
                removed = 0
                if len(spans):
                    a, b = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
                    opens = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                    a, b = a[opens], b[np.append(opens[1:], len(b)) - 1]
                    keep = np.ones(len(body) + 1, np.int8)
                    np.add.at(keep, a, -1)
                    np.add.at(keep, b, 1)
                    kept = body[np.cumsum(keep[:-1] - np.concatenate(([0], np.ones(max(len(body) - 1, 0), np.int8)))[: len(body)]) > 0].tobytes()
                    removed = len(body) - len(kept)
                else:
                    kept, opens = body.tobytes(), []
                out.append((len(body), removed, len(opens), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], names=names)

    return docs.select(F.when(F.col("id") != NO_KEY, F.col("id")).alias(key), "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans")).mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left.

    Cutting may split a character when strings end inside one; the hash is of the exact bytes, the text has
    the replacement character there.
    """
    docs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_KEY)).alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    runs = _runs(docs, length, k)
    often = runs.groupBy("key").agg(F.sum("times").alias("held")).where("held > 1")
    runs = cut(runs.drop("times").join(often, "key"))
    context = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") + (length - 1))
    # rows that repeat key and text have the same places: one of them for all, which then meets each of the rows once
    if not docs.groupBy("id", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty():
        runs = runs.dropDuplicates(["id", "th", "key", "start"])
    placed = runs.join(docs, ["id", "th"]).select("key", "held", "id", "th", "start", context.alias("context")).withColumn("ch", F.xxhash64("context"))
    counted = lambda rows: rows.groupBy("key", "ch").agg(F.count(F.lit(1)).alias("times"), F.first("context").alias("context"))
    found = _hot_repeats(counted(placed.where(f"held > {hot}")), counted(placed.where(f"held <= {hot}")), length, hot)
    spans = placed.select("key", "ch", "id", "th", "start").join(found, ["key", "ch"])
    packed = (F.shiftleft((F.col("start") + F.col("lo")).cast("bigint"), 32) + (F.col("start") + F.col("hi")).cast("bigint")).alias("span")
    spans = spans.select("id", "th", packed).groupBy("id", "th").agg(F.collect_set("span").alias("spans"))
    return _finish(docs.join(spans, ["id", "th"], "left"), key, text)
