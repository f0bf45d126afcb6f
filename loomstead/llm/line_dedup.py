"""Line dedup (operator 1): documents that share rare line hashes are aligned by patience diff; the later one loses
the aligned common blocks.

A block that is worth deleting has MIN_CHARS characters. Single lines are often frequent (menus, licence lines), runs of
lines are not, so the hashes that pair documents are those of the shortest runs of lines that reach MIN_CHARS, from each
line on and up to each line; such runs cover every block. A document meets the first holder of each of its runs,
so pairs stay linear in the lines, and whatever earlier document holds a block, all its runs have been met. Lines
travel as 64-bit hashes with their lengths, and only those inside shared runs do: a long document that shares one
passage with many sends that passage. A pair is aligned in rounds: patience diff on what is not aligned yet, until
nothing more aligns; what no alignment in order can reach (moved or repeated blocks) is found by a last look at the
runs of both. So the result does not depend on how often a line occurs: a document loses exactly the runs of
MIN_CHARS characters or more that an earlier document (by key) holds as well, judged on the input.

Defined results: a null text counts as empty; blank lines never pair documents but belong to blocks around
them; rows with equal key and equal text are one document and lose the same lines; of rows with equal key
and other texts the order of the text's hash decides which is later; a null key comes before all others;
repeats inside one document stay; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX1, cut, mix, prefix_sums, span_hashes
from .text_stats import SPACES

#: Characters that a block needs to be deleted.
MIN_CHARS = 60


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p] = v
            at[p] = i
        back[i] = at[p - 1] if p else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        once: dict[int, int] = {}
        for i in range(alo, ahi):
            once[a[i]] = -1 if a[i] in once else i
        other: dict[int, int] = {}
        for j in range(blo, bhi):
            other[b[j]] = -1 if b[j] in other else j
        both = [(i, other[h]) for h, i in once.items() if i >= 0 and other.get(h, -1) >= 0]
        if not both:
            continue
        both.sort()
        chain = [both[x] for x in _increasing([j for _, j in both])]
        for (i, j), (i2, j2) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)]):
            todo.append((i + 1, i2, j + 1, j2))
        out += chain
    return sorted(out)


def _numbered(lines: list) -> list[tuple]:
    seen: dict = {}
    out = []
    for h in lines:
        seen[h] = seen.get(h, 0) + 1
        out.append((h, seen[h]))
    return out


def shortest_runs(sizes: np.ndarray, solid: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of lines that are the shortest with `least` characters from their first line on or up to
    their last; runs of blank lines only are left out."""
    n = len(sizes)
    chars, full = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(solid)))
    at = np.arange(n)
    ends = np.searchsorted(chars, chars[:-1] + least, side="left")  # the smallest end with so many characters
    begins = np.searchsorted(chars, chars[1:] - least, side="right") - 1  # the largest begin
    start, end = np.concatenate((at[ends <= n], begins[begins >= 0])), np.concatenate((ends[ends <= n], at[begins >= 0] + 1))
    keep = (end > start) & (full[end] > full[start])
    both = np.unique(np.stack((start[keep], end[keep]), axis=1), axis=0)
    return both[:, 0], both[:, 1]


def common_blocks(a: list, b: list, sizes: list[int], solid: list[bool], least: int) -> list[int]:
    """Positions of a inside blocks of `least` characters or more that b holds too; sizes and solid are those of a's
    lines. Aligned blocks first, then the runs that no alignment in order reaches."""
    left_a, left_b = list(range(len(a))), list(range(len(b)))
    drop: set[int] = set()
    numbered = False
    while left_a and left_b:
        lines_a, lines_b = [a[i] for i in left_a], [b[j] for j in left_b]
        if numbered:
            lines_a, lines_b = _numbered(lines_a), _numbered(lines_b)
        found = [(left_a[i], left_b[j]) for i, j in patience(lines_a, lines_b)]
        if not found:
            if numbered:
                break
            numbered = True  # what is left repeats within a document: its first occurrence meets the first, and so on
            continue
        run: list[int] = []
        for k, (i, j) in enumerate(found):
            run.append(i)
            if k + 1 == len(found) or found[k + 1] != (i + 1, j + 1):
                if sum(sizes[x] for x in run) >= least and any(solid[x] for x in run):
                    drop.update(run)
                run = []
        used_a, used_b = {i for i, _ in found}, {j for _, j in found}
        left_a, left_b = [i for i in left_a if i not in used_a], [j for j in left_b if j not in used_b]
    gone = np.zeros(len(a) + 1, np.int64)
    gone[list(drop)] = 1
    if a and b:
        _last_look(a, b, np.array(sizes), np.array(solid, bool), least, gone)
    return np.flatnonzero(gone[:-1]).tolist()


def _last_look(a: list, b: list, sizes: np.ndarray, solid: np.ndarray, least: int, gone: np.ndarray) -> None:
    """Mark the shortest runs of a that stand in b too. Which runs are shortest follows from their own lines, so those of b
    are all that can be equal: both sides have two runs a line at most, compared by hashes from prefix sums."""
    code: dict = {}
    at_a, at_b = (np.array([code.setdefault(x, len(code)) for x in lines], np.int64) for lines in (a, b))
    size_of, solid_of = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    size_of[at_a], solid_of[at_a] = sizes, solid  # a line that only b has is in no common run
    hashed = []
    for at in (at_a, at_b):
        start, end = shortest_runs(size_of[at], solid_of[at], least)
        hashed.append((start, end, span_hashes(prefix_sums(mix(at.astype(np.uint64) + MIX1)), start, end)))
    (start, end, own), (_, _, other) = hashed
    upto = np.concatenate(([0], np.cumsum(gone[:-1])))
    found = (upto[end] - upto[start] < end - start) & np.isin(own, other)
    depth = np.zeros(len(a) + 1, np.int64)
    np.add.at(depth, start[found], 1)
    np.add.at(depth, end[found], -1)
    gone[np.cumsum(depth) > 0] = 1


def _keys(sequences: DataFrame, least: int) -> DataFrame:
    """(rid, h, start, end): the runs of each document that pair it with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, sizes, solid = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in batch.column(1)])))
            found, counts = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                start, end = shortest_runs(sizes[a:b], solid[a:b], least)
                hashes = span_hashes(prefix_sums(lines[a:b].view(np.uint64)), start, end).view(np.int64)
                found.append(np.stack((hashes, start, end)))
                counts.append(len(start))
            rid = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            h, start, end = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([rid, pa.array(h), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["rid", "h", "start", "end"])

    return sequences.select("rid", "lines", "sizes", "solid").mapInArrow(run, "rid struct<id: bigint, th: bigint>, h bigint, start int, end int")


def _shared(sequences: DataFrame, covered: DataFrame) -> DataFrame:
    """(rid, at, lines, sizes, solid): the lines of a document that lie in shared runs, and their positions."""
    inside = sequences.join(covered, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "at", "lines", "sizes", "solid"]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                columns = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
                depth = np.zeros(len(columns[0]) + 1, np.int32)
                spans = batch.column(4)[i].values
                np.add.at(depth, spans.field(0).to_numpy(), 1)
                np.add.at(depth, spans.field(1).to_numpy(), -1)
                at = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
                for held, column in zip(out, (at, *(c[at] for c in columns))):
                    held.append(column)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return inside.select("rid", "lines", "sizes", "solid", "spans").mapInArrow(run, "rid struct<id: bigint, th: bigint>, at array<int>, lines array<bigint>, sizes array<int>, solid array<boolean>")


def removed_lines(sequences: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(rid, gone): the positions that each document loses, for those that lose any."""

    def parted(at: list[int], *columns: list) -> tuple[list, ...]:
        """The lines with something that equals nothing else between those that do not follow each other."""
        out: tuple[list, ...] = ([], *([] for _ in columns))
        for i, p in enumerate(at):
            if i and at[i - 1] + 1 != p:
                for held, gap in zip(out, (-1, (object(),), 0, False)):
                    held.append(gap)
            for held, value in zip(out, (p, *(c[i] for c in columns))):
                held.append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            for i in range(batch.num_rows):
                late_at, late, sizes, solid, early_at, early = (batch.column(c)[i].values.to_pylist() for c in range(1, 7))
                places, a, sizes, solid = parted(late_at, late, sizes, solid)
                drop = [places[x] for x in common_blocks(a, parted(early_at, early)[1], sizes, solid, least)]
                found += drop
                at += [i] * len(drop)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(at, np.int64))), pa.array(found, pa.int32())], names=["rid", "gone"])

    keys = _keys(sequences, least)
    held = keys.groupBy("h").agg(F.min("rid").alias("early"), F.max("rid").alias("last")).where("early < last").select("h", "early")
    known = cut(keys.join(held, "h"))
    parts = cut(_shared(sequences, known.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))))
    pairs = known.where("early < rid").select(F.col("rid").alias("late"), "early").distinct()
    late = parts.select(F.col("rid").alias("late"), F.col("at").alias("late_at"), F.col("lines").alias("late_lines"), "sizes", "solid")
    early = parts.select(F.col("rid").alias("early"), F.col("at").alias("early_at"), F.col("lines").alias("early_lines"))
    aligned = pairs.join(late, "late").join(early, "early").select("late", "late_at", "late_lines", "sizes", "solid", "early_at", "early_lines")
    gone = aligned.mapInArrow(run, "rid struct<id: bigint, th: bigint>, gone int")
    return gone.groupBy("rid").agg(F.collect_set("gone").alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """All columns as they were, the text without the removed lines, and _n_lines, _n_removed (bigint).

    The removed lines' text goes with one line feed each; other text is untouched.
    """
    rid = F.struct(F.col(f"`{key}`").cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"))
    body = F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n")
    sequences = docs.select(rid.alias("rid"), body.alias("parts"))
    sequences = sequences.select(
        "rid",
        F.transform("parts", lambda x: F.xxhash64(x)).alias("lines"),
        F.transform("parts", lambda x: F.length(x)).alias("sizes"),
        F.transform("parts", lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("solid"),
    )
    sequences = cut(sequences.dropDuplicates(["rid"]))
    gone = removed_lines(sequences, least)
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), rid.alias("rid"))
    whole = held.join(gone, "rid", "left")
    parts = F.split(F.col(f"_row.`{text}`"), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    fresh = F.when(F.col("gone").isNull(), F.col(f"_row.`{text}`")).otherwise(kept)
    return whole.select(
        *[fresh.alias(text) if c == text else columns[i] for i, c in enumerate(docs.columns)],
        F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("_n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("_n_removed"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents after line dedup, with their own columns; those that lost every line go."""
    out = line_dedup(docs, key, text)
    return out.where("_n_removed = 0 OR _n_removed < _n_lines").select(*[F.col(f"`{c}`") for c in docs.columns])
