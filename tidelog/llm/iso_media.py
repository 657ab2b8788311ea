"""ISO base media containers: writing raw 8-bit frames, and probing any container's tables.

``probe`` walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables of each
track (stsd, mdhd, stts, stsc, stsz, stco/co64, stss) and derives codec, duration and the byte ranges
of keyframes. It never decodes a payload.

``write_raw_video`` stores bytes losslessly as 16 x 12 frames of 8-bit grey samples, 25 frames a second,
one chunk a second; the first frame of a chunk is marked as the keyframe.

Defined cases: a null or empty text gives one frame of spaces; equal texts give equal bytes; rows that
repeat an id are kept side by side; an empty table gives no rows; a container that breaks off or has
tables that contradict each other raises MediaError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH, HEIGHT, RATE = 16, 12, 25
FRAME = WIDTH * HEIGHT
#: Boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"moof", b"traf", b"mvex"}
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class MediaError(ValueError):
    pass


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_raw_video(payload: bytes) -> bytes:
    """A container whose samples are the payload's frames; its length is a positive multiple of FRAME."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise MediaError("the payload is not whole frames")
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    mdat_size = len(payload) + 8
    wide = mdat_size >= 1 << 32
    first = len(ftyp) + (16 if wide else 8)
    mdat = (struct.pack(">I4sQ", 1, b"mdat", mdat_size + 8) if wide else struct.pack(">I4s", mdat_size, b"mdat")) + payload
    chunks = -(-n // RATE)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, RATE if n >= RATE else n, 1)] + ([(chunks, n % RATE, 1)] if n % RATE and n > RATE else [])
    offsets = first + FRAME * RATE * np.arange(chunks, dtype=np.int64)
    large = offsets[-1] >= 1 << 32
    stbl = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, 1)),
        full_box(b"stss", struct.pack(">I", chunks), (1 + RATE * np.arange(chunks)).astype(">u4").tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", FRAME, n)),
        full_box(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
    )
    minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
    tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
    mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join([ftyp, mdat, box(b"moov", mvhd, box(b"trak", tkhd, mdia))])


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes between two offsets, and of those nested in them, however deep."""
    ends = [end]
    while ends:
        end = ends[-1]
        if start >= end:
            ends.pop()  # a container's body ends where the container does
            continue
        if start + 8 > end:
            raise MediaError("a box breaks off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("a box breaks off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError("a box leaves its parent")
        yield kind, start + head, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            start += head
        else:
            start += size


@dataclass
class Track:
    """What a track's tables say: offsets and sizes are arrays over its samples, keyframes their numbers from 0."""

    handler: str
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keyframes].tolist(), self.sizes[self.keyframes].tolist(), strict=True))

    def payload(self, data: bytes) -> bytes:
        """The samples' bytes in order; neighbours are read together."""
        if not len(self.sizes):
            return b""
        ends = self.offsets + self.sizes
        breaks = np.flatnonzero(ends[:-1] != self.offsets[1:]) + 1
        firsts, lasts = np.append(0, breaks), np.append(breaks, len(ends)) - 1
        return b"".join(data[a:b] for a, b in zip(self.offsets[firsts].tolist(), ends[lasts].tolist(), strict=True))


def _numbers(data: bytes, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    if at + 4 + n * columns * np.dtype(kind).itemsize > end:
        raise MediaError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    try:
        at, _ = boxes[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        handler = data[boxes[b"hdlr"][0] + 8 :][:4] if b"hdlr" in boxes else b"?"
        codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]
        at, end = boxes[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(n, same, np.int64) if same else _numbers(data, at + 8, end, 1)[:, 0]
        if b"co64" in boxes:
            chunk_at = _numbers(data, boxes[b"co64"][0] + 4, boxes[b"co64"][1], 1, ">u8")[:, 0]
        else:
            chunk_at = _numbers(data, boxes[b"stco"][0] + 4, boxes[b"stco"][1], 1)[:, 0]
        runs = _numbers(data, boxes[b"stsc"][0] + 4, boxes[b"stsc"][1], 3)
        stts = _numbers(data, boxes[b"stts"][0] + 4, boxes[b"stts"][1], 2)
        sync = _numbers(data, boxes[b"stss"][0] + 4, boxes[b"stss"][1], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(n)
    except (KeyError, struct.error) as e:
        raise MediaError(f"a table is missing or breaks off: {e}") from e
    if n:
        if not len(runs) or runs[0, 0] != 1:
            raise MediaError("no samples for the first chunk")
        if (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunk_at):
            raise MediaError("the runs of chunks don't rise")
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1)))
    else:
        per_chunk = np.zeros(len(chunk_at), np.int64)
    if per_chunk.sum() != n or stts[:, 0].sum() != n or (len(sync) and (sync.min() < 0 or sync.max() >= n)):
        raise MediaError("the sample tables contradict each other")
    chunk = np.repeat(np.arange(len(chunk_at)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = chunk_at[chunk] + before - before[first[chunk]]
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise MediaError("a sample lies outside the container")
    return Track(handler.decode("latin-1"), codec.decode("latin-1"), timescale, duration or int((stts[:, 0] * stts[:, 1]).sum()), offsets, sizes, sync)


def probe(data: bytes) -> list[Track]:
    """The container's tracks, from its boxes alone."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for kind, start, end in walk(data, 0, len(data)):
        if kind == b"trak":
            tracks.append({})
        elif tracks:
            tracks[-1].setdefault(kind, (start, end))
    return [_track(data, t) for t in tracks]


def feature(track: Track) -> str:
    ranges = ",".join(f"{a}+{n}" for a, n in track.keyframe_ranges())
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(track.keyframes)};ranges={ranges}"


def payload_of(text: str) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes with spaces up to a positive multiple of FRAME."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def store_media(docs: DataFrame) -> DataFrame:
    """Write each text as a container into the shared folder; the table doc_id, n_bytes, media."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            n, payloads = zip(*map(payload_of, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(n, pa.int64()), "media": pa.array(map(write_raw_video, payloads), pa.binary())})

    return common.staged(common.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored containers back and describe them. Columns: SCHEMA."""

    def row(doc: int, n_bytes: int, data: bytes) -> tuple:
        (track,) = probe(data)
        payload = track.payload(data)
        return doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = [row(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = zip(*rows, strict=True) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)
