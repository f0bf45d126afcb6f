"""Media columns (operator 9): ISO base media files as binary columns, indexed without decoding payloads.

`store_payload` writes a payload of 8-bit samples as a one-track ISO media file; `index_media` walks
the nested boxes of any such file, decodes its sample tables and gives codec, duration and the byte
range of every keyframe. `media_columns` applies both to a text column by an Arrow map: no shuffle,
one text at a time in memory.

Defined results: a null text counts as empty (64 zero bytes are stored); equal texts give equal
values; repeated rows give repeated results; an empty table gives an empty one; other columns of the
input are not read. A key that is null stays null. Bytes that are no such file, cut short or contradicting
themselves are indexed as far as their boxes go: tables are read within their box, a sample size that holds for
all samples counts for no more samples than there are bytes, boxes nest NESTING deep at most.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of a sample (access unit), samples of a chunk, samples from one keyframe to the next, samples a second.
UNIT, CHUNK, SYNC, RATE = 64, 1024, 16, 8000

#: Depth to which boxes in boxes are walked.
NESTING = 32

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

#: Unity transformation matrix of movie and track headers (fixed values of the format).
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _movie(n: int, first: int) -> bytes:
    """The moov box for n samples of UNIT bytes that start at byte `first`."""
    chunks = -(-n // CHUNK)
    tail = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if tail == CHUNK else [(1, tail, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, tail, 1)]
    offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
    sync = np.arange(1, n + 1, SYNC, dtype=">u4")
    length = n * UNIT
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
    )
    data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1),
        _full(b"hdlr", struct.pack(">I4s", 0, b"soun"), b"\0" * 12, b"payload\0"),
        _box(b"minf", _full(b"smhd", b"\0" * 4), data, tables),
    )
    track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8, version=1, flags=7)
    movie = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, length, 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1)
    return _box(b"moov", movie, _box(b"trak", track, media))


def store_payload(payload: bytes) -> bytes:
    """An ISO media file whose samples are the payload; its length must be a positive multiple of UNIT."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    at = len(head) + len(_movie(n, 0)) + len(mdat)
    return b"".join((head, _movie(n, at), mdat, payload))


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the body, end) of every box, depth first; a box that overruns its parent ends its level."""
    levels = [(0, len(data), ())]
    while levels:
        start, end, path = levels.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                continue
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            continue
        yield path + (kind,), body, stop
        levels.append((stop, end, path))
        if kind in CONTAINERS and len(path) < NESTING:
            levels.append((body, stop, path + (kind,)))


@dataclass
class Track:
    """What the boxes of one track say."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    sync: np.ndarray | None = None
    #: (offset, size, is a keyframe) of the samples of movie fragments, in file order.
    fragments: list[tuple[int, int, bool]] = field(default_factory=list)

    def offsets(self) -> np.ndarray:
        """Byte offset of every sample, from the chunk offsets, the samples a chunk and the sizes."""
        n, k = len(self.sizes), len(self.chunks)
        if not n or not k or not len(self.runs):
            return np.zeros(0, np.int64)
        first = np.clip(self.runs[:, 0], 1, k + 1)
        until = np.maximum(np.append(first[1:], k + 1) - first, 0)
        per = np.minimum(np.repeat(self.runs[:, 1], until)[:k], n)
        per[np.cumsum(per) - per >= n] = 0  # chunks behind the last sample
        chunk = np.repeat(np.arange(len(per)), per)[:n]
        before = np.concatenate(([0], np.cumsum(self.sizes)))[: len(chunk)]
        first = np.concatenate(([0], np.cumsum(per)))[chunk]
        return self.chunks[chunk] + before - before[np.minimum(first, len(before) - 1)]

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """(offset, size) of every keyframe; without a sync table every sample is one. Those of fragments follow."""
        at = self.offsets()
        pick = np.arange(len(at)) if self.sync is None else self.sync[(self.sync >= 1) & (self.sync <= len(at))] - 1
        more = np.array([(o, n) for o, n, key in self.fragments if key], np.int64).reshape(-1, 2)
        return np.concatenate((at[pick], more[:, 0])), np.concatenate((self.sizes[pick], more[:, 1]))


def _fragment(view: memoryview, at: int, stop: int, base: int, fixed: tuple[int, int]) -> list[tuple[int, int, bool]]:
    """Samples of a track run: fixed are the size and flags where the run gives none. The flag 0x10000 marks what is no keyframe."""
    flags, n = struct.unpack_from(">II", view, at)
    flags &= 0xFFFFFF
    at += 8
    offset = base
    if flags & 1 and at + 4 <= stop:
        offset += struct.unpack_from(">i", view, at)[0]
    at += 4 * bool(flags & 1)
    first = struct.unpack_from(">I", view, at)[0] if flags & 4 and at + 4 <= stop else None
    at += 4 * bool(flags & 4)
    width = 4 * sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
    n = min(n, (stop - at) // width if width else len(view) // max(fixed[0], 1))
    out = []
    for i in range(n):
        row = at + 4 * bool(flags & 0x100)
        size = struct.unpack_from(">I", view, row)[0] if flags & 0x200 else fixed[0]
        row += 4 * bool(flags & 0x200)
        own = struct.unpack_from(">I", view, row)[0] if flags & 0x400 else first if i == 0 and first is not None else fixed[1]
        if offset < 0 or offset + size > len(view):
            break
        out.append((offset, size, not own & 0x10000))
        offset += size
        at += width
    return out


def index_media(data: bytes) -> list[Track]:
    """The tracks of an ISO media file by its boxes alone; bytes that are no such file give none."""
    view, tracks = memoryview(data), []
    by_number: dict[int, Track] = {}
    defaults: dict[int, tuple[int, int]] = {}  # by track: size and flags of fragment samples
    moof, number, base, own = 0, 0, 0, (0, 0)

    def array(at: int, stop: int, kind: str) -> np.ndarray:
        n = min(struct.unpack_from(">I", view, at)[0], (stop - at - 4) // np.dtype(kind).itemsize)
        return np.frombuffer(view, kind, n, at + 4).astype(np.int64)

    for path, at, stop in walk(view):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"moof":
            moof = at - 8
        if stop - at < 8:
            continue
        if kind == b"trex" and stop - at >= 24:
            track, _, _, size, flags = struct.unpack_from(">5I", view, at + 4)
            defaults[track] = (size, flags)
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", view, at)
            base, own = moof, defaults.get(number, (0, 0))
            place = at + 8
            for bit, width in ((1, 8), (2, 4), (8, 4), (0x10, 4), (0x20, 4)):
                if flags & bit and place + width <= stop:
                    value = int.from_bytes(view[place : place + width], "big")
                    base = value if bit == 1 else base
                    own = (value, own[1]) if bit == 0x10 else (own[0], value) if bit == 0x20 else own
                    place += width
        elif kind == b"trun" and number in by_number:
            found = _fragment(view, at, stop, base, own)
            by_number[number].fragments += found
            base = found[-1][0] + found[-1][1] if found else base
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"tkhd" and stop - at >= (24 if view[at] == 1 else 16):
            by_number[struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]] = t
        elif kind == b"mdhd" and stop - at >= (32 if view[at] == 1 else 20):
            t.timescale, t.duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
        elif kind == b"stsd" and stop - at >= 16:
            t.codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == b"stsz" and stop - at >= 12:
            same, n = struct.unpack_from(">II", view, at + 4)
            t.sizes = np.full(min(n, len(data) // same), same, np.int64) if same else array(at + 8, stop, ">u4")
        elif kind == b"stco":
            t.chunks = array(at + 4, stop, ">u4")
        elif kind == b"co64":
            t.chunks = array(at + 4, stop, ">u8")
        elif kind == b"stss":
            t.sync = array(at + 4, stop, ">u4")
        elif kind == b"stsc":
            n = min(struct.unpack_from(">I", view, at + 4)[0], (stop - at - 8) // 12)
            t.runs = np.frombuffer(view, ">u4", 3 * n, at + 8).astype(np.int64).reshape(n, 3)
    return tracks


def read_payload(data: bytes, track: Track) -> bytes:
    """The samples of a track in order, read by its tables; samples that follow each other are read as one run."""
    at = track.offsets()
    if not len(at):
        return b""
    ends = at + track.sizes[: len(at)]
    breaks = np.flatnonzero(at[1:] != ends[:-1]) + 1
    starts, stops = at[np.concatenate(([0], breaks))], ends[np.append(breaks - 1, len(at) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist()))


SCHEMA = (
    "{key} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, codec string, duration_seconds double, n_samples bigint, n_keyframes bigint, "
    "keyframe_offsets array<bigint>, keyframe_sizes array<bigint>, media binary"
)


def _row(text: bytes) -> tuple:
    padded = text + b"\0" * (-len(text) % UNIT if text else UNIT)
    media = store_payload(padded)
    track = index_media(media)[0]
    payload = read_payload(media, track)
    offsets, sizes = track.keyframes()
    seconds = track.duration / track.timescale
    feature = f"codec={track.codec};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};chunks={len(track.chunks)};keyframes={len(offsets)};first={offsets[0]}+{sizes[0]};last={offsets[-1]}+{sizes[-1]}"
    return (
        len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, track.codec, seconds, len(track.sizes), len(offsets), offsets, sizes, media,
    )


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", stored: bool = True) -> DataFrame:
    """One row per document: its text stored as an ISO media file, read back and indexed. The file is the binary column
    `media`; without `stored` it is left out, so that its bytes never leave the worker."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    schema = SCHEMA.format(key=key) if stored else SCHEMA.format(key=key).removesuffix(", media binary")
    names = [f.strip().split()[0] for f in schema.split(",")]
    kinds = kinds[: len(names) - 1]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), text):
                rows = [_row((x.as_py() or "").encode())[: len(kinds)] for x in part.column(1)]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(convert, schema)
