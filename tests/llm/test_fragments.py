"""Containers whose samples are in fragments, made by hand."""

import struct

import numpy as np
import pytest

from verdigris.llm import media
from verdigris.llm.media import box, full

#: Flags of a sample that depends on others, and of one that doesn't.
DELTA, SYNC = 0x01010000, 0x02000000


def header(number=7, default=(10, 0, DELTA), wide=False):
    """A movie without samples of its own."""
    empty = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    track = box(
        b"trak",
        full(b"tkhd", struct.pack(">QQI", 0, 0, number) if wide else struct.pack(">III", 0, 0, number), bytes(60), version=int(wide)),
        box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", empty)),
    )
    return box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", full(b"mvhd", bytes(96)), track, box(b"mvex", full(b"trex", struct.pack(">IIIII", number, 1, *default))))


def run(samples, offset=None, first=None, kinds=0x100 | 0x200 | 0x400):
    """A run of (duration, size, flags)."""
    flags = kinds | (0x1 if offset is not None else 0) | (0x4 if first is not None else 0)
    parts = [struct.pack(">I", len(samples))]
    parts += [struct.pack(">i", offset)] if offset is not None else []
    parts += [struct.pack(">I", first)] if first is not None else []
    for sample in samples:
        parts += [struct.pack(">I", v) for v, bit in zip(sample, (0x100, 0x200, 0x400), strict=True) if kinds & bit]
    return full(b"trun", *parts, flags=flags)


def fragment(make, payload):
    """A fragment and its data; ``make`` gets the data's place after the fragment's beginning."""
    size = len(make(0))
    return make(size + 8) + box(b"mdat", payload)


def test_samples_of_fragments():
    head = header()
    payload = bytes(range(60))
    one = fragment(lambda at: box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run([(40, 10, SYNC), (40, 20, DELTA)], at), run([(20, 30, SYNC)]))), payload)
    later = bytes(reversed(range(24)))
    # sizes and durations by default, the first sample's flags apart
    two = fragment(lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">III", 7, 25, 8), flags=0x20000 | 0x8 | 0x10), run([(0, 0, 0)] * 3, at, SYNC, 0))), later)
    data = head + one + two
    assert media.samples(data) == payload + later
    found = media.describe(data)
    start = data.index(payload)
    second = data.index(later)
    assert found == {"codec": "avc1", "kind": "vide", "duration": (100 + 75) / 1000, "n_samples": 6, "keyframes": [{"offset": start, "length": 10}, {"offset": start + 30, "length": 30}, {"offset": second, "length": 8}], "error": None}


@pytest.mark.parametrize("wide", [False, True])
def test_places_by_base_offset_and_defaults_of_the_movie(wide):
    """A header that names its data's place in the container; durations, sizes and flags of the movie's defaults."""
    head, payload = header(9, (5, 6, SYNC), wide), b"abcdefghijkl"
    data = box(b"mdat", payload)
    part = box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQ", 9, len(head) + 8), flags=0x1), run([(0, 0, 0)] * 2, kinds=0)))
    found = media.describe(head + data + part)
    assert media.samples(head + data + part) == payload
    assert (found["n_samples"], found["duration"], [k["length"] for k in found["keyframes"]], found["error"]) == (2, 0.01, [6, 6], None)


def test_second_track_in_a_fragment_follows_the_first():
    """Without a base of its own a track's data begins where the one before has ended."""
    first, second = header(1, (1, 4, SYNC)), header(2, (1, 4, SYNC))
    movie = lambda h: h[h.index(b"moov") + 4 :]
    head = box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", movie(first), movie(second))
    make = lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 2)), run([(0, 0, 0)], at, kinds=0)), box(b"traf", full(b"tfhd", struct.pack(">I", 1)), run([(0, 0, 0)] * 2, kinds=0)))
    data = head + fragment(make, b"secnfirstone")
    assert media.samples(data) == b"firstone"
    offsets, sizes = media.read(data)[1].samples(len(data))
    assert [data[o : o + n] for o, n in zip(offsets, sizes, strict=True)] == [b"secn"]


def test_movie_and_fragments_together():
    """A container with sample tables that goes on in a fragment."""
    payload = bytes(range(192)) * 3
    whole = media.write(payload)
    more = b"z" * 384
    part = fragment(lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IIII", 1, 192, 192, SYNC), flags=0x20000 | 0x38), run([(0, 0, 0)] * 2, at, kinds=0))), more)
    found = media.describe(whole + part)
    assert media.samples(whole + part) == payload + more
    assert found["n_samples"] == 5 and len(found["keyframes"]) == 1 + 2 and found["duration"] == (3 + 2) * 192 / 8000


@pytest.mark.parametrize(
    "part",
    [
        box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 8)))),  # no such track
        box(b"moof", box(b"traf", run([(1, 1, 0)]))),  # no header
        box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run([(1, 1 << 20, 0)]))),  # data beyond the end
        box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7)), full(b"trun", struct.pack(">I", 2**32 - 1)))),  # a count of nothing
        box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7)), full(b"trun", struct.pack(">I", 50), flags=0x200))),  # a table cut short
        box(b"moof", box(b"traf", full(b"tfhd"))),
    ],
)
def test_broken_fragments_are_errors(part):
    assert media.describe(header() + part)["error"]


def test_fragments_as_column(spark):
    payload = bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))
    part = fragment(lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run([(1, 50, SYNC if k % 10 == 0 else DELTA) for k in range(100)], at))), payload)
    df = spark.createDataFrame([(1, bytearray(header() + part)), (2, bytearray(header())), (3, None)], "id int, media binary")
    got = {r.id: r for r in media.read_payload(media.media_info(df)).collect()}
    assert bytes(got[1].payload) == payload and got[1].info.n_samples == 100 and len(got[1].info.keyframes) == 10
    assert bytes(got[2].payload) == b"" and got[2].info.n_samples == 0 and got[2].info.error is None
    assert got[3].payload is None and got[3].info is None
