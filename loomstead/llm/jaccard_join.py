"""N-gram Jaccard join (operator 7): universe partition, pigeonhole, one-deletion neighbourhoods, exact check.

A document is its set of distinct word shingles. Sets are put in bands of size; two sets that reach the
threshold lie in the same band or in neighbouring ones and differ by at most H elements, H following from
the larger band. The universe of shingles is hashed into H + 1 segments, so at least one segment of such a
pair is equal. A set is indexed under its segments. Segments of one element or none are costly: all sets
with the same gap, or the same popular shingle on its own, would meet there. A set leaves its costly segments
out when it can give each one's share to a reserve segment of three elements or more, in which it then also
finds sets that differ by one element: those are indexed with their one-deletion neighbourhoods too. There are
as many reserve segments as the less filled sets of a band are expected to need; a set that needs more leaves
out its empty segments only, or nothing, so the search stays exact. Documents that meet under a key are candidates, and every
candidate pair is checked exactly on its whole texts.

Sets that are equal form classes first (by a 128-bit hash of the set), and a task indexes a class once. In
a key group of up to SMALL sets all pairs are candidates. In a larger one each set is paired with the
smallest id; where that leaves several components, with the member that shares most keys of such groups; and members
that are still in different components are paired with each other, unless folded parity sketches show that they differ in too many elements (an exact
bound), so no link that joins components is lost and no large group emits all its pairs.

Defined results: a null, empty or blank text has an empty set, links with nothing and is its own
component; a null key is kept with a null component; rows that repeat a key share a component; an empty
table gives an empty one; no column but key and text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX1, MIX2, bytes_of, cut, lower_ascii, mix, prefix_sums, slices, span_hashes, word_spans
from .components import components

#: Words of a shingle and threshold (NUM / DEN) of the op7 contract.
SHINGLE, NUM, DEN = 4, 85, 100

#: Ratio of a band's sizes, group size up to which all pairs are candidates, rows of one numpy pass over groups.
RATIO, SMALL, ROWS = 1.5, 3, 1 << 18

#: Bits of a folded parity sketch.
FOLD = 512


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a text column (nulls give none)."""
    data, offsets = bytes_of(column)
    data = lower_ascii(data)
    start, end, row = word_spans(data, offsets)
    word = span_hashes(prefix_sums(data), start, end)
    first = np.searchsorted(row, np.arange(len(column) + 1))
    n = len(word)
    run = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        run[: n - j] = run[: n - j] * MIX1 + word[j:]
    run = mix(run)
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    whole = whole * MIX2 + w
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Bands of set sizes: band b holds sizes from low[b] to below low[b + 1]."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < largest:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * max(RATIO, den / num * 1.05))))
        self.low_array = np.array(self.low)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low_array, n, side="right")) - 1

    def segments(self, band: int) -> int:
        """H + 1: sets up to the band's largest size that link differ by H elements at most."""
        high = self.low[band + 1] - 1
        return 2 * high * (self.den - self.num) // (self.den + self.num) + 1

    def reserve(self, band: int) -> int:
        """Reserve segments: the costly ones that the band's smaller sets expect, and a standard deviation."""
        m = self.segments(band)
        filled = 1.15 * self.low[band] / m
        costly = m * math.exp(-filled) * (1 + filled)
        return min(m, math.ceil(costly + math.sqrt(costly)))

    def of(self, n: int) -> list[int]:
        """The bands under which a set of n elements is indexed: its own, and the next if a partner may lie there."""
        b = self.band(n)
        return [b, b + 1] if self.den * n >= self.num * self.low[b + 1] else [b]


def index_keys(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """All index keys of a set."""
    out = []
    mixed = mix(elements)
    for band in bands.of(len(elements)):
        m = bands.segments(band)
        if m == 1:  # links within the band are equal sets, which classes give
            continue
        segment = (elements >> np.uint64(20)) % np.uint64(m)
        order = np.argsort(segment, kind="stable")
        sizes = np.bincount(segment.astype(np.int64), minlength=m)
        ends = np.cumsum(sizes)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[order])))
        value = sums[ends] - sums[ends - sizes]
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40))
        reserve = np.flatnonzero(sizes[: bands.reserve(band)] >= 3)
        # leave out what the reserve can stand for: all segments of one element or none, or the empty ones, or nothing;
        # of two sets the one that leaves out more finds the other, which indexes all that it needs
        least = next(x for x in (2, 1, 0) if np.count_nonzero(sizes < x) <= len(reserve))
        out.append((value * MIX1 ^ tag)[sizes >= least])
        for i in reserve.tolist():
            out.append((value[i] - mixed[order[ends[i] - sizes[i] : ends[i]]]) * MIX1 ^ tag[i])
    return np.unique(mix(np.concatenate(out))) if out else np.zeros(0, np.uint64)


def _set_hash(elements: np.ndarray) -> tuple[int, int]:
    a, b = mix(elements ^ MIX1).sum(dtype=np.uint64), mix(elements + MIX2).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: every element flips one of two to four times as many bits (FOLD at least, a power of two).

    Two sketches, the longer folded, differ in no more bits than the sets differ in elements, so a pair whose
    sketches differ in more than its sets may is ruled out exactly.
    """
    bits = max(FOLD, 1 << (2 * len(elements)).bit_length())
    flips = np.bincount(((elements >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    # unsigned, because the count of a negative number is that of its absolute value
    return int(np.bitwise_count((a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).view(np.uint64)).sum())


def set_info(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, c1, c2, sketch, fold): size, 128-bit hash and parity sketch of every row's shingle set, and the sketch
    folded to FOLD bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = []
            for s in shingle_sets(part.column(1), k):
                bits = sketch(s)
                found.append((len(s), *_set_hash(s), bits, np.bitwise_xor.reduce(bits.reshape(-1, FOLD // 64), axis=0)))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n", "c1", "c2", "sketch", "fold"])

    return docs.mapInArrow(run, "id bigint, n bigint, c1 bigint, c2 bigint, sketch array<bigint>, fold array<bigint>")


def _index(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, id) of every class that a task sees first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for part in slices(batches, "text"):
            ids = part.column(0).to_numpy(zero_copy_only=False)
            keys, owner = [], []
            for i, s in enumerate(shingle_sets(part.column(1), k)):
                if not len(s) or (c := _set_hash(s)) in seen:
                    continue
                seen.add(c)
                found = index_keys(s, bands)
                keys.append(found)
                owner.append(np.full(len(found), ids[i], np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], names=["key", "id"])

    return docs.mapInArrow(run, "key bigint, id bigint")


def _candidates(index: DataFrame) -> DataFrame:
    """(kind, a, b): kind 0 are candidate pairs a < b; kind 1 are members (key, id) of groups over SMALL.

    Rows come sorted by key and id and are read once; of an open group at most SMALL + 1 rows are held.
    """

    def pairs(key: np.ndarray, ids: np.ndarray, first: np.ndarray, large: np.ndarray) -> list[np.ndarray]:
        """first: index of the row that opens each row's group; large: whether the group is over SMALL."""
        a, b = [ids[first[large]]], [ids[large]]
        for d in range(1, SMALL):
            same = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:])
            if not len(same):
                break
            a.append(ids[same])
            b.append(ids[same + d])
        a, b = np.concatenate(a), np.concatenate(b)
        differ = a != b
        both = np.unique(np.stack((a[differ], b[differ]), axis=1), axis=0)
        return [np.zeros(len(both), np.int32), both[:, 0], both[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        opened: tuple[int, int] | None = None  # key and smallest id of a group over SMALL that goes on

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, opened
            if not held:
                return
            key, ids = (np.concatenate(x) for x in zip(*held))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (ids[1:] == ids[:-1])
            key, ids = key[~again], ids[~again]
            if opened and key[0] == opened[0] and ids[0] != opened[1]:
                key, ids = np.concatenate(([opened[0]], key)), np.concatenate(([opened[1]], ids))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            large = sizes > SMALL
            if opened and key[0] == opened[0]:
                large[0] = True
            held, opened = [], None
            stop = len(starts)
            if not last:
                if large[-1]:
                    opened = (int(key[-1]), int(ids[starts[-1]]))
                else:  # the last group may go on: keep its few rows for the next pass
                    stop -= 1
                    held = [(key[starts[-1] :], ids[starts[-1] :])]
            n = len(key) if stop == len(starts) else int(starts[-1])
            some = np.repeat(sizes[:stop] > 1, sizes[:stop]) | np.repeat(large[:stop], sizes[:stop])
            first = np.repeat(starts[:stop], sizes[:stop])
            key, ids, is_large = key[:n], ids[:n], np.repeat(large[:stop], sizes[:stop])
            if some.any():
                at = np.cumsum(some) - 1
                found = pairs(key[some], ids[some], at[first[some]], is_large[some])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
            if is_large.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(is_large.sum()), np.int32)), pa.array(key[is_large]), pa.array(ids[is_large])], names=names)

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= ROWS:
                yield from flush(False)
                rows = sum(len(k) for k, _ in held)
        yield from flush(True)

    return index.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "kind int, a bigint, b bigint")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in slices(batches, "text_a"):
            for part in slices(iter([wide]), "text_b"):
                good = np.zeros(part.num_rows, bool)
                for i, (s, t) in enumerate(zip(shingle_sets(part.column(2), k), shingle_sets(part.column(3), k))):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    good[i] = common > 0 and den * common >= num * (len(s) + len(t) - common)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))

    one = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _split_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label) of the members of groups that hold more than one component."""
    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return named.join(split, "key")


def _second_stars(split: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of split groups with the group's member that is in most of them, if they are not of its
    component yet: the smallest id may be an odd one, the member that shares most segments is a typical one."""
    places = split.groupBy("id").agg(F.count(F.lit(1)).alias("places"))
    centre = split.join(places, "id").groupBy("key").agg(F.max(F.struct("places", (-F.col("id")).alias("_i"), "label")).alias("c"))
    meet = split.join(centre, "key").where("label <> c.label").select("id", (-F.col("c._i")).alias("centre"))
    return meet.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _near(num: int, den: int) -> str:
    """Condition that the sketches of x and y do not rule a link out: first those folded to FOLD bits, whose differences
    saturate in sets of more elements, then the whole ones, the longer folded once to the length of the shorter."""
    most = f"floor((x.n + y.n) * {den - num} / {den + num})"
    folded = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(FOLD // 64))
    total = "aggregate({}, 0, (s, v) -> s + v)".format
    same = total("zip_with(x.deep, y.deep, (p, q) -> bit_count(p ^ q))")
    once = lambda a, b: total(f"transform({b}.deep, (q, i) -> bit_count(q ^ {a}.deep[i] ^ {a}.deep[i + size({b}.deep)]))")
    whens = [
        f"WHEN size(x.deep) = size(y.deep) THEN {same} <= {most}",
        f"WHEN size(x.deep) = 2 * size(y.deep) THEN {once('x', 'y')} <= {most}",
        f"WHEN size(y.deep) = 2 * size(x.deep) THEN {once('y', 'x')} <= {most}",
    ]
    return f"coalesce({folded} <= {most}, true) AND CASE WHEN x.deep IS NULL OR y.deep IS NULL THEN true {' '.join(whens)} ELSE true END"


def _unresolved(split: DataFrame, names: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of one split group that are in different components and that sketches do not rule out.

    Two sets differ in no fewer elements than their parity sketches differ in bits, folded or whole. Where that is more
    than linked sets may differ in, the pair is left out by the join's condition. A pair that meets under several keys
    comes from the smallest of them.
    """
    left = cut(split)
    deep = F.when(F.size("sketch") > FOLD // 64, F.col("sketch")).alias("deep")
    folds = names.select("id", F.col("hi").alias("n"), *[F.col("fold")[i].alias(f"s{i}") for i in range(FOLD // 64)], deep)
    left = left.join(left.groupBy("id").agg(F.collect_set("key").alias("keys")), "id").join(folds, "id")
    x, y = left.alias("x"), left.alias("y")
    meet = x.join(y, F.expr(f"x.key = y.key AND x.id < y.id AND x.label <> y.label AND {_near(num, den)} AND array_min(array_intersect(x.keys, y.keys)) = x.key"))
    return meet.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: components of the graph of components, which is small."""
    own = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    joined = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    roots = cut(components(joined.where("a <> b").distinct()))
    fresh = roots.select("id").join(labels.select("id"), "id", "left_anti")
    known = labels.select("id", "component").union(fresh.select("id", F.col("id").alias("component")))
    return known.join(roots.select(F.col("id").alias("component"), F.col("component").alias("_root")), "component", "left").select("id", F.coalesce("_root", "component").alias("component"))


def _canonical(pairs: DataFrame, names: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs by the smallest id of either class, without those of one class and those that sizes or sketches
    rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(3), batch.column(4)
            good = np.ones(batch.num_rows, bool)
            for i, most in enumerate(batch.column(2).to_pylist()):
                x, y = xs[i].values, ys[i].values
                good[i] = x is None or y is None or sketch_distance(x.to_numpy(), y.to_numpy()) <= most
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    side = lambda own, rep: names.select(F.col("id").alias(own), F.col("rep").alias(rep), F.col("lo").alias(f"{rep}lo"), F.col("hi").alias(f"{rep}hi"), F.col("sketch").alias(f"{rep}s"))
    ids = names.select("id", "rep")
    one = pairs.join(ids.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b")
    named = one.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    two = named.join(side("a", "x").drop("x"), "a").join(side("b", "y").drop("y"), "b")
    near = two.where(f"xhi * {den} >= ylo * {num} AND yhi * {den} >= xlo * {num}")
    most = F.floor((F.col("xhi") + F.col("yhi")) * (den - num) / (den + num)).cast("bigint")
    return near.select("a", "b", most.alias("most"), "xs", "ys").mapInArrow(run, "a bigint, b bigint")


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(info, labels): set size of every row, and the component of every id that has a link."""
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    info = cut(set_info(docs, k))
    whole = info.where("n > 0 AND id IS NOT NULL")
    classes = whole.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
    known = cut(whole.join(classes, ["c1", "c2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "sketch", "fold"))
    equal = known.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # an id of several rows stands for itself, whatever classes they are in
    names = known.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.min("rep")).otherwise(F.col("id")).alias("rep"), F.min("n").alias("lo"), F.max("n").alias("hi"), *[F.when(F.count(F.lit(1)) == 1, F.first(c)).alias(c) for c in ("sketch", "fold")])
    docs = docs.where("id IS NOT NULL")
    found = cut(_candidates(_index(docs, k, num, den)).distinct())
    pairs = cut(_canonical(found.where("kind = 0").select("a", "b"), names, num, den))
    links = cut(_verify(pairs, docs, k, num, den).union(equal))
    labels = cut(components(links))
    members = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id"))
    members = cut(members.join(names.select("id", "rep"), "id").select("key", F.col("rep").alias("id")).distinct())
    done = pairs
    for more in (_second_stars, lambda split: _unresolved(split, names, num, den)):
        rest = cut(_canonical(more(_split_groups(members, labels)), names, num, den).join(done, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            labels = cut(_merged(labels, cut(_verify(rest, docs, k, num, den))))
        done = done.union(rest)
    return info, labels


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: key, n_shingles, component_id."""
    info, labels = jaccard_links(docs, key, text, k, num, den)
    out = info.join(labels, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of which one of each component stays, that of the smallest key. Rows that repeat key and text are one
    document, of which one row stays; rows without a key come after all others, by the hash of their text; rows that
    repeat a key with other texts stay or go together."""
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    own = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(1 << 62) + F.shiftrightunsigned(th, 3))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own.alias("_id"), th.alias("_th"), F.col(f"`{text}`").alias("_text"))
    _, labels = jaccard_links(rows.select("_id", "_text"), "_id", "_text", k, num, den)
    drop = labels.where("id <> component").select(F.col("id").alias("_id"))
    return rows.join(drop, "_id", "left_anti").dropDuplicates(["_id", "_th"]).select(*columns)


def components_sql(source: str = "SELECT doc_id, text FROM documents", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> str:
    """DuckDB CTEs up to `linked` (doc_id, n_shingles, component_id); for WITH RECURSIVE."""
    return rf"""src AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM ({source})),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM src),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+{k - 1}], ' ') END AS s
       FROM w, UNNEST(range(1, greatest(len(w) - {k - 2}, 2))) AS u(i) WHERE len(w) > 0),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM sh p JOIN sh q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
          JOIN size m ON m.doc_id = x.a JOIN size n ON n.doc_id = x.b WHERE {den} * i >= {num} * (m.n + n.n - i)),
reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
linked AS (SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
           FROM w LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = w.doc_id)"""


ORACLE = f"WITH RECURSIVE {components_sql()} SELECT * FROM linked"
