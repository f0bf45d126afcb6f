"""SentencePiece encoding and decoding (operator 8): forward filtering, backward sampling over the piece lattice.

A text is taken as bytes behind one space, as the model's dummy prefix has it; a piece's word mark stands for
a space, and a literal word mark in a text is spelt in byte pieces, so decoding gives the very bytes back.
The lattice of a text has an edge for every piece that matches at a byte, and a costly byte piece at each.
No piece goes on past a space that follows a letter, nor over a line feed, so the lattice falls apart into
chunks there, and sampling chunks one by one is sampling the whole. For the distinct chunks of a slice of
texts the forward sums are computed once; every occurrence then draws its pieces backwards. A draw is a hash
of the seed, the row's key, the chunk's number in its text and the step, so a row's segmentation is the same
in any partitioning and on any retry.

Piece weights are a Zipf law over the vocabulary's ranks to the power `alpha` (the model stores merge ranks,
not probabilities). Every slice is decoded and compared with its texts.

Defined results: a null or empty text has no pieces; a null key draws as key 0; repeated rows repeat; an empty
table gives an empty one; no column but key and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix, prefix_sums, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Log weight that a byte piece loses against the rarest piece; the usual penalty of unknown characters.
BYTE_PENALTY = 10.0

#: Leading bits by which hashes of prefixes are looked up.
SLOT_BITS = 18
SLOT_SHIFT = np.uint64(64 - SLOT_BITS)


@dataclass
class Vocabulary:
    """Pieces as bytes with log weights; small (bounded by the vocabulary) and shipped with each task."""

    pieces: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=dict)

    @staticmethod
    def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, byte_ids = [b""] * n, np.full(256, -1, np.int64)
        rank = 0
        weights = np.zeros(n)
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                pieces[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = name.replace("▁", " ").encode()
                weights[i] = -alpha * np.log(rank + 10.0)
                rank += 1
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so texts could not be encoded losslessly")
        weights[byte_ids] = -alpha * (np.log(rank + 10.0) + BYTE_PENALTY)
        return Vocabulary(pieces, weights, byte_ids)

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """By length: sorted hashes of all prefixes of pieces, the piece that each is, or -1, where the hashes with
        each SLOT_BITS first bits begin, and how many at most have the same."""
        if not self.prefixes:
            found: dict[bytes, int] = {}
            for i, p in enumerate(self.pieces):
                if not p or self.byte_ids[p[0]] == i and len(p) == 1:
                    continue
                if b" " in p.lstrip(b" ") or b"\n" in p:
                    continue  # would cross a chunk
                for n in range(1, len(p)):
                    found.setdefault(p[:n], -1)
                found[p] = i
            names = list(found)
            sizes = np.array([len(x) for x in names])
            ends = np.cumsum(sizes)
            hashes = span_hashes(prefix_sums(np.frombuffer(b"".join(names), np.uint8)), ends - sizes, ends)
            ids = np.array([found[x] for x in names])
            for n in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == n)
                of = of[np.argsort(hashes[of])]
                slots = np.searchsorted(hashes[of] >> SLOT_SHIFT, np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64))
                # one hash more than there is, so that the place after the last can be looked at
                self.prefixes[n] = (np.append(hashes[of], np.uint64(0)), np.append(ids[of], -1), slots[:-1].astype(np.int32), int(np.diff(slots).max()))
            lengths = np.array([len(p) for p in self.pieces])
            self.bounds = np.concatenate(([0], np.cumsum(lengths)))
            self.joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        return self.prefixes

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of pieces."""
        self.tables()
        sizes = self.bounds[ids + 1] - self.bounds[ids]
        ends = np.cumsum(sizes)
        return self.joined[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[ids] - ends + sizes, sizes)]


def _edges(text: np.ndarray, stop: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every edge, by end; stop: where the chunk of each byte ends."""
    sums = prefix_sums(text)
    at = np.arange(len(text))
    starts, ends, ids = [at], [at + 1], [vocabulary.byte_ids[text]]
    for n, (hashes, piece, slots, most) in sorted(vocabulary.tables().items()):
        at = at[at + n <= stop[at]]
        if not len(at):
            break
        h = span_hashes(sums, at, at + n)
        place = slots[h >> SLOT_SHIFT]
        hit = hashes[place] == h
        for _ in range(most - 1):
            miss = np.flatnonzero(~hit)
            place[miss] = np.minimum(place[miss] + 1, len(hashes) - 1)
            hit[miss] = hashes[place[miss]] == h[miss]
        at, place = at[hit], place[hit]
        some = piece[place] >= 0
        starts.append(at[some])
        ends.append(at[some] + n)
        ids.append(piece[place[some]])
    start, end, ids = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
    by = np.argsort(end, kind="stable")
    return start[by], end[by], ids[by]


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, offsets of each text's) for non-empty texts `data[offsets[i]:offsets[i + 1]]`."""
    rows = len(offsets) - 1
    n = len(data) + rows
    text = np.full(n, 32, np.uint8)
    heads = offsets[:-1] + np.arange(rows)
    body = np.ones(n, bool)
    body[heads] = False
    text[body] = data
    opens = np.zeros(n, bool)
    opens[1:] = (text[1:] == 32) & (text[:-1] != 32) | (text[1:] == 10) | (text[:-1] == 10)
    opens[heads] = True
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n)
    row = np.searchsorted(heads, first, side="right") - 1
    number = np.arange(len(first)) - np.searchsorted(first, heads)[row]
    _, where, chunk = np.unique(span_hashes(prefix_sums(text), first, last), return_index=True, return_inverse=True)
    # the distinct chunks one after the other
    sizes = (last - first)[where]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    small = text[np.arange(ends[-1]) + np.repeat(first[where] - begins, sizes)]
    start, end, piece = _edges(small, np.repeat(ends, sizes), vocabulary)
    # forward: log sums over all ways to each byte, for all chunks at once by distance from their start
    origin = np.repeat(begins, sizes)  # of the byte before a node
    reach = np.full(len(small) + 1, -np.inf)
    from_start = np.zeros(len(start), bool)
    from_start[:] = start == origin[start]
    weight = vocabulary.weights[piece]
    distance = end - origin[start]
    by = np.argsort(distance, kind="stable")
    steps = np.searchsorted(distance[by], np.arange(1, int(distance.max()) + 2))
    ways = np.empty(len(start))
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        if a == b:
            continue
        e = by[a:b]
        value = np.where(from_start[e], 0.0, reach[start[e]]) + weight[e]
        nodes = end[e]
        cut = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        top = np.maximum.reduceat(value, cut)
        share = np.diff(np.append(cut, len(e)))
        reach[nodes[cut]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, share)), cut))
        ways[e] = value
    # backward: the edges into a node as a cumulative share of it, all on one axis
    node = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
    count = np.diff(np.append(node, len(end)))
    share = np.exp(ways - reach[end])
    total = np.concatenate(([0.0], np.cumsum(share)))
    line = np.repeat(np.arange(len(node)), count) + (total[1:] - np.repeat(total[node], count)) / np.repeat(total[node + count] - total[node], count)
    last_edge = node + count - 1
    at = ends[chunk] - 1  # index of the node that ends a chunk: every byte ends one
    live = np.argsort(chunk, kind="stable")  # equal chunks together: their nodes are close in memory
    base = mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed))[row] + number.astype(np.uint64))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    pieces = np.zeros(len(chunk), np.int64)
    begin = begins[chunk]
    while len(live):
        u = (mix(base[live] + np.uint64(len(drawn))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        nodes = at[live]
        edge = np.clip(np.searchsorted(line, nodes + u, side="right"), node[nodes], last_edge[nodes])
        drawn.append((live, piece[edge]))
        pieces[live] += 1
        at[live] = start[edge] - 1
        live = live[start[edge] > begin[live]]
    bounds = np.concatenate(([0], np.cumsum(pieces)))
    out = np.zeros(bounds[-1], np.int64)
    for step, (who, ids) in enumerate(drawn):
        out[bounds[who + 1] - 1 - step] = ids
    return out, bounds[np.append(np.searchsorted(first, heads), len(first))]


def _decoded(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts by their pieces, without the prefix space of non-empty ones."""
    spelt = vocabulary.spell(ids)
    sizes = np.concatenate(([0], np.cumsum((vocabulary.bounds[ids + 1] - vocabulary.bounds[ids]))))
    ends = sizes[bounds]
    some = ends[1:] > ends[:-1]
    keep = np.ones(len(spelt), bool)
    keep[ends[:-1][some]] = False
    return spelt[keep], np.concatenate(([0], np.cumsum(np.diff(ends) - some)))


def _checked(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sample(), and whether each text's pieces give it back."""
    ids, bounds = sample(data, offsets, keys, vocabulary, seed)
    back, ends = _decoded(ids, bounds, vocabulary)
    if len(back) == len(data) and np.array_equal(back, data) and np.array_equal(ends, offsets):
        return ids, bounds, np.ones(len(offsets) - 1, bool)
    return ids, bounds, np.array([np.array_equal(back[ends[j] : ends[j + 1]], data[offsets[j] : offsets[j + 1]]) for j in range(len(offsets) - 1)])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """One row per document: key, n_bytes, n_pieces, pieces array<int>, lossless (decoded pieces give the text)."""
    vocabulary = Vocabulary.load(model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = bytes_of(part.column(1))
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            keys = part.column(0).fill_null(0).to_numpy()
            counts = np.zeros(part.num_rows, np.int64)
            ids, good = np.zeros(0, np.int64), np.ones(part.num_rows, bool)
            if len(some):
                packed = np.concatenate(([0], np.cumsum(sizes[some])))
                ids, bounds, same = _checked(data, packed, keys[some], vocabulary, seed)
                if not same.all():  # two chunks with one hash, against all odds: a text at a time has fewer chunks to mix up
                    each = [_checked(data[a:b], np.array([0, b - a]), keys[i : i + 1], vocabulary, seed) for i, a, b in zip(some.tolist(), packed[:-1].tolist(), packed[1:].tolist())]
                    ids, bounds = np.concatenate([e[0] for e in each]), np.concatenate(([0], np.cumsum([len(e[0]) for e in each])))
                    same = np.array([e[2][0] for e in each])
                counts[some], good[some] = np.diff(bounds), same
            pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(counts), pieces, pa.array(good)], names=[key, "n_bytes", "n_pieces", "pieces", "lossless"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, f"{key} bigint, n_bytes bigint, n_pieces bigint, pieces array<int>, lossless boolean"
    )


def decode(pieces: Column, model: str = MODEL) -> Column:
    """The text of a column of piece arrays; null gives null."""
    vocabulary = Vocabulary.load(model)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            spelt = None if x.as_py() is None else vocabulary.spell(np.array(x.as_py(), np.int64)).tobytes()
            out.append(None if spelt is None else spelt[1:].decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return text_of(pieces)
