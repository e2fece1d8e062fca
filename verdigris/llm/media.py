"""Media columns: ISO media containers as binary values.

The reader walks nested boxes and decodes sample tables; it looks at no payload byte to find codec,
duration, samples and keyframe byte ranges. The writer stores bytes as 8-bit samples of one track.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdigris.llm.arrow import with_columns

UNIT, RATE = 192, 8000
PER_CHUNK, PER_KEYFRAME = 64, 32
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class MediaError(ValueError):
    """A container whose boxes or tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write(payload: bytes) -> bytes:
    """A container of one sound track with ``payload`` as 8-bit samples in units of 192; its length is a positive multiple of that."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    n = len(payload) // UNIT
    chunks = -(-n // PER_CHUNK)
    duration = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, min(PER_CHUNK, n), 1)] + ([(chunks, n - PER_CHUNK * (chunks - 1), 1)] if chunks > 1 and n % PER_CHUNK else [])
    keys = np.arange(1, n + 1, PER_KEYFRAME)

    def movie(first: int) -> bytes:
        wide = first + duration >= 2**32
        offsets = first + np.arange(chunks, dtype=np.uint64) * (PER_CHUNK * UNIT)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3), media)
        header = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IHH8x", 0x10000, 0x100, 0), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", header, track)

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    data = box(b"mdat", payload)
    start = len(data) - len(payload)
    first = len(kind) + len(movie(0)) + start
    return kind + movie(first) + data


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)
    number: int = 0
    #: Duration, size and flags of a fragment's samples that don't say.
    defaults: tuple[int, int, int] = (0, 0, 0)
    #: Offsets, sizes and sync marks of each run of a fragment.
    runs: list = field(default_factory=list)

    def samples(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets and sizes of all samples, those of fragments last; ``end`` is the container's length."""
        offsets, sizes = self._whole(end)
        return (np.concatenate([offsets, *(r[0] for r in self.runs)]), np.concatenate([sizes, *(r[1] for r in self.runs)])) if self.runs else (offsets, sizes)

    def _whole(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the movie's own tables."""
        t = self.tables
        count, sizes = t.get(b"stsz", (0, np.zeros(0, np.int64)))
        if b"stco" not in t or b"stsc" not in t:
            if count:
                raise MediaError("samples without chunks")
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunks, runs = t[b"stco"], t[b"stsc"]
        if len(chunks) == 0 and count == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(runs) == 0 or len(chunks) == 0 or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or (runs[:, 1] < 0).any():
            raise MediaError("bad chunk runs")
        per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 1]
        if per.sum() != count:
            raise MediaError(f"{count} samples, {per.sum()} in chunks")
        of = np.repeat(np.arange(len(chunks)), per)
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        base = before[np.minimum(first, max(count - 1, 0))] if count else np.zeros(len(chunks), np.int64)
        offsets = chunks[of] + before - base[of]
        if count and (offsets.min() < 0 or (offsets + sizes).max() > end):
            raise MediaError("a sample ends beyond the container")
        return offsets, sizes

    def keyframes(self) -> np.ndarray:
        """Places of the sync samples, all where no table is."""
        count = self.tables.get(b"stsz", (0, None))[0]
        keys = self.tables.get(b"stss")
        if keys is not None and len(keys) and (keys.min() < 1 or keys.max() > count):
            raise MediaError("a keyframe is no sample")
        found = [np.arange(count) if keys is None else keys - 1]
        for offsets, _, sync in self.runs:
            found.append(count + np.flatnonzero(sync))
            count += len(offsets)
        return np.concatenate(found)


#: Bits of a fragment's header and of its runs, and of a sample's flags: it depends on others.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST, RUN_FIELDS, FROM_MOOF, NO_SYNC = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800), 0x20000, 0x10000


class Fragment:
    """The state of a movie fragment's box: where it begins, where its data has been read to, and the track that runs belong to."""

    def __init__(self, start: int) -> None:
        self.start = self.end = start
        self.track: Track | None = None

    def head(self, data: memoryview, a: int, tracks: list[Track]) -> None:
        flags, number = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        at = a + 8
        if (track := next((t for t in tracks if t.number == number), None)) is None:
            raise MediaError(f"a fragment of track {number}, which isn't there")
        base = self.start if flags & FROM_MOOF or self.track is None else self.end
        if flags & BASE_OFFSET:
            base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 * bool(flags & DESCRIPTION)
        values = list(track.defaults)
        for k, bit in enumerate((DURATION, SIZE, FLAGS)):
            if flags & bit:
                values[k], at = struct.unpack_from(">I", data, at)[0], at + 4
        self.track, self.base, self.end, self.defaults = track, base, base, values

    def run(self, data: memoryview, a: int, b: int) -> None:
        if self.track is None:
            raise MediaError("a run before its fragment's header")
        flags, count = struct.unpack_from(">II", data, a)
        at = a + 8
        if flags & RUN_OFFSET:
            self.end, at = self.base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & RUN_FIRST:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        fields = [bit for bit in RUN_FIELDS if flags & bit]
        if count > len(data) or at + 4 * count * len(fields) > b:
            raise MediaError("a run is cut short")
        table = np.frombuffer(data, ">u4", count * len(fields), at).astype(np.int64).reshape(count, len(fields))
        duration, sizes, marks = (table[:, fields.index(bit)] if bit in fields else np.full(count, default, np.int64) for bit, default in zip(RUN_FIELDS[:3], self.defaults, strict=True))
        if first is not None and count and RUN_FIELDS[2] not in fields:
            marks[0] = first
        ends = self.end + np.cumsum(sizes)
        if count and (self.end < 0 or ends[-1] > len(data)):
            raise MediaError("a sample ends beyond the container")
        self.track.runs.append((ends - sizes, sizes, marks & NO_SYNC == 0))
        self.track.duration += int(duration.sum())
        self.end = int(ends[-1]) if count else self.end


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box in a range."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("a box ends in its size")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} of {size} bytes in {end - start}")
        yield kind, start + head, start + size
        start += size


def _table(kind: bytes, data: memoryview, a: int, b: int) -> tuple[bytes, object]:
    def numbers(at: int, count: int, form: str = ">u4") -> np.ndarray:
        if at + count * np.dtype(form).itemsize > b:
            raise MediaError(f"table {kind!r} is cut short")
        return np.frombuffer(data, form, count, at).astype(np.int64)

    if kind == b"stsz":
        fixed, count = struct.unpack_from(">II", data, a + 4)
        if fixed * count > len(data):
            raise MediaError(f"{count} samples of {fixed} bytes in {len(data)}")
        return kind, (count, np.full(count, fixed, np.int64) if fixed else numbers(a + 12, count))
    count = struct.unpack_from(">I", data, a + (8 if kind == b"stz2" else 4))[0]
    if kind == b"stz2":
        bits = data[a + 7]
        if bits == 4:
            raw = numbers(a + 12, (count + 1) // 2, ">u1")
            return b"stsz", (count, np.stack([raw >> 4, raw & 15], 1).ravel()[:count])
        return b"stsz", (count, numbers(a + 12, count, {8: ">u1", 16: ">u2"}[bits]))
    if kind in (b"stco", b"co64"):
        return b"stco", numbers(a + 8, count, ">u8" if kind == b"co64" else ">u4")
    if kind == b"stss":
        return kind, numbers(a + 8, count)
    return kind, numbers(a + 8, count * (3 if kind == b"stsc" else 2)).reshape(-1, 3 if kind == b"stsc" else 2)


def read(media: bytes) -> list[Track]:
    """The tracks of a container."""
    data, tracks = memoryview(media), []
    defaults: dict[int, tuple[int, int, int]] = {}

    def walk(start: int, end: int, depth: int, fragment: Fragment | None = None) -> None:
        if depth > 16:
            raise MediaError("boxes nest too deeply")
        at = start
        for kind, a, b in boxes(data, start, end):
            at, begin = b, at
            if kind == b"trak":
                tracks.append(Track())
            if kind in NESTED:
                walk(a, b, depth + 1, Fragment(begin) if kind == b"moof" else fragment)
                if kind == b"moov":
                    for track in tracks:
                        track.defaults = defaults.get(track.number, track.defaults)
            elif kind == b"trex":
                number, _, *values = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = tuple(values)
            elif kind == b"tfhd" and fragment is not None:
                fragment.head(data, a, tracks)
            elif kind == b"trun" and fragment is not None:
                fragment.run(data, a, b)
            elif kind == b"tkhd" and tracks:
                tracks[-1].number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd" and tracks:
                wide = data[a] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"hdlr" and tracks:
                tracks[-1].kind = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd" and tracks:
                tracks[-1].codec = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), "")
            elif kind in (b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss") and tracks:
                name, values = _table(kind, data, a, b)
                tracks[-1].tables[name] = values

    try:
        walk(0, len(data), 0)
    except (struct.error, KeyError, IndexError) as e:
        raise MediaError(f"a box is cut short: {e}") from e
    if not tracks:
        raise MediaError("no track")
    return tracks


INFO = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
        T.StructField("error", T.StringType()),
    ]
)


def describe(media: bytes | None) -> dict | None:
    """Codec, duration in seconds, samples and keyframe byte ranges of the first track, its fragments included; ``error`` for a container that can't be read, None for null."""
    if media is None:
        return None
    try:
        track = read(media)[0]
        offsets, sizes = track.samples(len(media))
        keys = track.keyframes()
        return {"codec": track.codec, "kind": track.kind, "duration": track.duration / track.timescale if track.timescale else 0.0, "n_samples": len(sizes), "keyframes": [{"offset": int(o), "length": int(n)} for o, n in zip(offsets[keys], sizes[keys], strict=True)], "error": None}
    except MediaError as e:
        return {"error": str(e)}


def samples(media: bytes) -> bytes:
    """The samples of the first track, in order."""
    offsets, sizes = read(media)[0].samples(len(media))
    if not len(sizes):
        return b""
    new = np.flatnonzero(np.concatenate([[True], offsets[1:] != (offsets + sizes)[:-1]]))  # adjacent samples are one range
    ends = np.concatenate([new[1:], [len(sizes)]]) - 1
    return b"".join(media[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(new.tolist(), ends.tolist(), strict=True))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store_text(df: DataFrame, text_col: str = "text", media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Adds ``media_col``: the text's UTF-8 bytes, filled with spaces to a positive multiple of 192, in a container.

    Null counts as empty. Equal texts, repeated rows among them, have equal containers. Other columns stay; one of that name is replaced.
    """
    return with_columns(df, text_col, [T.StructField(media_col, T.BinaryType())], lambda b: [pa.array([write(padded(x)) for x in b.column(text_col).to_pylist()], pa.binary())], keep)


def media_info(df: DataFrame, media_col: str = "media", info_col: str = "info", keep: list[str] | None = None) -> DataFrame:
    """Adds ``info_col``, a struct with what the container says of its first track, or an error; null for null.

    Rows are described one by one, so repeated rows get equal values. Counts in a table are held against the
    container's length before anything is made of them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(INFO)
    return with_columns(df, media_col, [T.StructField(info_col, INFO)], lambda b: [pa.array([describe(x) for x in b.column(media_col).to_pylist()], kind)], keep)


def read_payload(df: DataFrame, media_col: str = "media", payload_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Adds ``payload_col``: the bytes of all samples of the first track; null for null and for what can't be read. Repeated rows
    have equal payloads, and an empty table gives no rows."""

    def one(media: bytes | None) -> bytes | None:
        try:
            return None if media is None else samples(media)
        except MediaError:
            return None

    return with_columns(df, media_col, [T.StructField(payload_col, T.BinaryType())], lambda b: [pa.array([one(x) for x in b.column(media_col).to_pylist()], pa.binary())], keep)
