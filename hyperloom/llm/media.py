"""ISO media containers: mux bytes losslessly, walk the nested boxes, decode the sample tables.

A payload becomes the samples of one video track: every 64 bytes are a frame of 64 x 1 pixels of 8-bit grey
(sample entry `raw `, depth 40), so the sample bytes are the payload as it is. The reader takes any
ISO base media file: it walks the box tree, reads only the headers and the sample tables, and returns
codec, duration and the byte ranges of the keyframes; samples are never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.columnar import by_batch, id_and_text

FRAME = 64
FRAMES_PER_CHUNK = 64
KEYFRAME_EVERY = 16
TIMESCALE = 25
#: Boxes that hold boxes; the number is that of the bytes before the first one.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


#: Levels of boxes; files have fewer than ten.
DEEPEST = 64


class MediaError(ValueError):
    """The bytes are no readable ISO media file."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """`data` with zero bytes up to a positive multiple of the frame size."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def mux(payload: bytes) -> bytes:
    """A file of one track whose samples are the frames of `payload`, a positive multiple of 64 bytes."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise MediaError("the payload is no positive multiple of the frame size")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    full_chunks, last = divmod(frames, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK)] * bool(full_chunks) + [(full_chunks + 1, last)] * bool(last)
    chunks = full_chunks + bool(last)
    sync = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    entry = struct.pack(">6xH", 1) + struct.pack(">16xHHIIIH32sHh", FRAME, 1, 72 << 16, 72 << 16, 0, 1, bytes([4]) + b"grey", 40, -1)

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * FRAME)
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
            _full(b"stss", 0, 0, struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", 0, 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            _full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            minf,
        )
        tkhd = _full(b"tkhd", 1, 7, struct.pack(">QQI4xQ8xHHH2x", 0, 0, 1, frames, 0, 0, 0), matrix, struct.pack(">II", FRAME << 16, 1 << 16))
        mvhd = _full(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, frames, 1 << 16, 256), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    size = len(payload) + 8
    mdat = struct.pack(">I4s", size, b"mdat") if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    before = len(head) + len(moov(0)) + len(mdat)
    if before + len(payload) >= 1 << 32:
        before = len(head) + len(moov(1 << 32)) + len(mdat)
    return head + moov(before) + mdat + payload


def boxes(data: bytes, start: int, end: int):
    """(kind, body start, body end) of the boxes of a span; 64-bit sizes, and 0 for up to the end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("a 64-bit box size is cut off")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} at {start} has the impossible size {size}")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    """One track's tables, decoded; byte ranges are [start, end) of the file."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> np.ndarray:
        """Rows of (start, end) of the keyframes."""
        return np.stack([self.starts[self.sync], self.starts[self.sync] + self.sizes[self.sync]], 1) if len(self.sync) else np.zeros((0, 2), np.int64)


def _table(data: bytes, at: int, end: int, kind: str, width: int) -> np.ndarray:
    """The entries after a 32-bit count, as rows of `width` numbers."""
    (count,) = struct.unpack_from(">I", data, at)
    step = np.dtype(kind).itemsize * width
    if at + 4 + count * step > end:
        raise MediaError("a sample table is cut off")
    return np.frombuffer(data, kind, count * width, at + 4).astype(np.int64).reshape(count, width)


def _walk(data: bytes, start: int, end: int, found: dict, tracks: list[dict], depth: int = 0) -> None:
    if depth > DEEPEST:
        raise MediaError(f"boxes are nested over {DEEPEST} deep")
    for kind, at, stop in boxes(data, start, end):
        if kind == b"trak":
            tracks.append({})
            _walk(data, at, stop, tracks[-1], tracks, depth + 1)
        elif kind in CONTAINERS:
            _walk(data, at + CONTAINERS[kind], stop, found, tracks, depth + 1)
        else:
            found.setdefault(kind, (at, stop))


def _sample_sizes(data: bytes, parts: dict[bytes, tuple[int, int]]) -> np.ndarray | None:
    """The sizes of all samples, from either kind of table."""
    if b"stsz" in parts:
        at, end = parts[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, at + 4)
        if fixed and count * fixed > len(data):
            raise MediaError("samples lie outside the file")
        return np.full(count, fixed, np.int64) if fixed else _table(data, at + 8, end, ">u4", 1)[:, 0]
    if b"stz2" not in parts:
        return None
    at, end = parts[b"stz2"]
    bits, count = struct.unpack_from(">II", data, at + 4)
    bits &= 0xFF
    if bits not in (4, 8, 16) or at + 12 + (count * bits + 7) // 8 > end:
        raise MediaError("a sample table is cut off")
    if bits == 16:
        return np.frombuffer(data, ">u2", count, at + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, (count * bits + 7) // 8, at + 12)
    return (raw if bits == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:count]).astype(np.int64)


def _track(data: bytes, parts: dict[bytes, tuple[int, int]]) -> Track:
    out = Track()
    try:
        if b"hdlr" in parts:
            out.handler = data[parts[b"hdlr"][0] + 8 : parts[b"hdlr"][0] + 12].decode("latin-1")
        if b"mdhd" in parts:
            at = parts[b"mdhd"][0]
            out.timescale, out.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        if b"stsd" in parts:
            at, end = parts[b"stsd"]
            first = next(boxes(data, at + 8, end), None)
            out.codec = first[0].decode("latin-1") if first else ""
        sizes = _sample_sizes(data, parts)
        if sizes is None:
            return out
        out.sizes = sizes
        where = b"co64" if b"co64" in parts else b"stco"
        offsets = _table(data, parts[where][0] + 4, parts[where][1], ">u8" if where == b"co64" else ">u4", 1)[:, 0]
        runs = _table(data, parts[b"stsc"][0] + 4, parts[b"stsc"][1], ">u4", 3)
        if len(offsets) and not len(runs) or len(runs) and runs[0, 0] != 1:
            raise MediaError("the chunk table doesn't cover all chunks")
        if (np.diff(np.append(runs[:, 0], len(offsets) + 1)) < 0).any():
            raise MediaError("the chunk table's runs are out of order")
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(offsets) + 1)))
        if per_chunk.sum() != len(out.sizes):
            raise MediaError("the chunk table and the size table differ in their number of samples")
        before = np.cumsum(out.sizes) - out.sizes
        first_of = np.cumsum(per_chunk) - per_chunk
        filled = per_chunk > 0
        out.starts = np.repeat(offsets[filled] - before[first_of[filled]], per_chunk[filled]) + before
        if len(out.starts) and (out.starts.min() < 0 or (out.starts + out.sizes).max() > len(data)):
            raise MediaError("samples lie outside the file")
        out.sync = _table(data, parts[b"stss"][0] + 4, parts[b"stss"][1], ">u4", 1)[:, 0] - 1 if b"stss" in parts else np.arange(len(out.sizes))
        if len(out.sync) and (out.sync.min() < 0 or out.sync.max() >= len(out.sizes)):
            raise MediaError("the keyframe table names samples that there are not")
    except (struct.error, KeyError, IndexError) as e:
        raise MediaError(f"a sample table is missing or cut off: {e}") from e
    return out


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, in file order."""
    tracks: list[dict] = []
    others: dict = {}
    _walk(data, 0, len(data), others, tracks)
    if not tracks:
        raise MediaError("no track")
    if b"trun" in others:
        raise MediaError("samples in fragments are not read")
    return [_track(data, parts) for parts in tracks]


def samples(data: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order; neighbours are read as one range."""
    if not len(track.starts):
        return b""
    ends = track.starts + track.sizes
    first = np.flatnonzero(np.append(True, track.starts[1:] != ends[:-1]))
    last = np.append(first[1:] - 1, len(ends) - 1)
    return b"".join(data[a:b] for a, b in zip(track.starts[first].tolist(), ends[last].tolist(), strict=True))


MEDIA_SCHEMA = "codec string, handler string, timescale long, duration long, seconds double, n_samples long, keyframes array<struct<start:long,end:long>>, error string"


def _ranges(tables: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*tables, np.zeros((0, 2), np.int64)])
    pair = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tables)]), pa.int32()), pair)


def media_columns(df: DataFrame, key: str, content: str) -> DataFrame:
    """Codec, duration and keyframe ranges of the first track of each file in a binary column.

    One row per input row: `key` and the columns of MEDIA_SCHEMA. Null, empty, damaged or fragmented files give
    a row with `error` set, no keyframes and nulls elsewhere. Other input columns are not read.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py() or b""
                try:
                    t = read_tracks(data)[0]
                    values, keys = [t.codec, t.handler, t.timescale, t.duration, t.seconds, len(t.sizes)], t.keyframes()
                    error = None
                except MediaError as e:
                    values, keys, error = [None] * 6, np.zeros((0, 2), np.int64), str(e)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                cols = [batch.column(0).slice(row, 1), *(pa.array([v], k) for v, k in zip(values, kinds, strict=True)), _ranges([keys]), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["k", "codec", "handler", "timescale", "duration", "seconds", "n_samples", "keyframes", "error"])

    made = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{content}`").cast("binary").alias("b"))
    return made.mapInArrow(run, f"k long, {MEDIA_SCHEMA}").withColumnRenamed("k", key)


STORED_SCHEMA = "k long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<start:long,end:long>>"


def _stored(part: pa.RecordBatch) -> pa.RecordBatch:
    rows, keyframes = [], []
    for text in part.column(1).to_pylist():
        data = (text or "").encode()
        file = mux(padded(data))
        track = read_tracks(file)[0]
        back = samples(file, track)
        keys = track.keyframes()
        keyframes.append(keys)
        feature = f"{track.handler}:{track.codec.strip()}:{len(track.sizes)} samples of {FRAME}:{track.duration}/{track.timescale}s:{len(keys)} keyframes:{zlib.crc32(keys.astype('<i8').tobytes()):08x}"
        rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(file), hashlib.sha256(file).hexdigest(), feature, track.codec, track.seconds))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = [x.split()[0] for x in STORED_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([part.column(0), *cols, _ranges(keyframes)], names)


def text_as_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as a media file and read back, with its digests and features; one row per input row.

    A null text is an empty one: one frame of zeros. Equal texts give equal values; repeated rows stay
    repeated; an empty table gives an empty result. Input columns other than the two are not read.
    """
    return by_batch(id_and_text(df, key, text), _stored, STORED_SCHEMA).withColumnRenamed("k", key)
