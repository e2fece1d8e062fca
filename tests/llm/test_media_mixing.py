import hashlib
import struct
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.util import assert_same
from verdigris.llm import media, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 128, 1000])
def test_container_round_trip(n):
    payload = bytes((i * 7 + n) % 256 for i in range(n * media.UNIT))
    stored = media.write(payload)
    assert media.samples(stored) == payload
    info = media.describe(stored)
    assert (info["codec"], info["kind"], info["n_samples"], info["duration"]) == ("raw ", "soun", n, n * media.UNIT / media.RATE)
    assert [stored[k["offset"] : k["offset"] + k["length"]] for k in info["keyframes"]] == [payload[i * 192 : i * 192 + 192] for i in range(0, n, media.PER_KEYFRAME)]


def by_hand(payload):
    """The container again, box by box in hexadecimal, by another way than the writer's."""
    n, size = len(payload) // 192, len(payload)
    chunks = (n + 63) // 64
    u4 = lambda *x: b"".join(int(v).to_bytes(4, "big") for v in x)
    wrap = lambda kind, body: u4(len(body) + 8) + kind.encode() + body
    matrix = bytes.fromhex("00010000 00000000 00000000 00000000 00010000 00000000 00000000 00000000 40000000")
    long = lambda v: int(v).to_bytes(8, "big")
    head = wrap("ftyp", b"isom" + u4(512) + b"isomiso2")

    def moov(first):
        keys = range(1, n + 1, 32)
        runs = [1, min(64, n), 1] + ([chunks, n - 64 * (chunks - 1), 1] if chunks > 1 and n % 64 else [])
        stsd = wrap("stsd", u4(0, 1) + wrap("raw ", bytes.fromhex("000000000000 0001 0000 0000 00000000 0001 0008 0000 0000 1f400000")))
        tables = [stsd, wrap("stts", u4(0, 1, n, 192)), wrap("stss", u4(0, len(keys), *keys)), wrap("stsc", u4(0, len(runs) // 3, *runs)), wrap("stsz", u4(0, 192, n)), wrap("stco", u4(0, chunks, *[first + 64 * 192 * k for k in range(chunks)]))]
        minf = wrap("minf", wrap("smhd", bytes(8)) + wrap("dinf", wrap("dref", u4(0, 1) + wrap("url ", u4(1)))) + wrap("stbl", b"".join(tables)))
        mdhd = wrap("mdhd", u4(0x01000000) + long(0) * 2 + u4(8000) + long(size) + bytes.fromhex("55c40000"))
        mdia = wrap("mdia", mdhd + wrap("hdlr", bytes(8) + b"soun" + bytes(13)) + minf)
        tkhd = wrap("tkhd", u4(0x01000003) + long(0) * 2 + u4(1, 0) + long(size) + bytes(8) + bytes.fromhex("0000 0000 0100 0000") + matrix + bytes(8))
        mvhd = wrap("mvhd", u4(0x01000000) + long(0) * 2 + u4(8000) + long(size) + bytes.fromhex("00010000 0100 0000 0000000000000000") + matrix + bytes(24) + u4(2))
        return wrap("moov", mvhd + wrap("trak", tkhd + mdia))

    return head + moov(len(head) + len(moov(0)) + 8) + wrap("mdat", payload)


@pytest.mark.parametrize("n", [1, 33, 64, 65, 200])
def test_container_as_made_by_hand(n):
    payload = bytes((i * 11 + n) % 251 for i in range(n * media.UNIT))
    assert media.write(payload) == by_hand(payload)


def test_keyframes_do_not_depend_on_payload():
    stored = media.write(b"x" * 192 * 100)
    assert media.describe(stored[: -192 * 100] + bytes(192 * 100)) == media.describe(stored)


def test_damaged_containers_give_errors():
    stored = media.write(b"x" * 192 * 70)
    for broken in (b"", b"abc", stored[:100], stored[:-1], stored[:500] + stored[600:], struct.pack(">I4s", 8, b"free")):
        assert media.describe(broken)["error"]
    assert media.describe(None) is None


def test_counts_are_held_against_the_length():
    """A few bytes that claim very many samples cost no memory."""
    for sizes in ((1, 300_000_000), (0xFFFFFFFF, 0xFFFFFFFF), (0, 300_000_000)):
        table = media.box(b"stbl", media.full(b"stsc", struct.pack(">I3I", 1, 1, sizes[1], 1)), media.full(b"stsz", struct.pack(">2I", *sizes)), media.full(b"stco", struct.pack(">II", 1, 8)))
        stored = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", table))))
        tracemalloc.start()
        assert media.describe(stored)["error"]
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
        tracemalloc.stop()


def test_variable_sizes_and_wide_offsets():
    # two chunks, out of order, sizes listed sample by sample, 64-bit offsets, no sync table
    body = b"CCCC" + b"AABBB"
    table = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(8))), media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", struct.pack(">5I", 0, 3, 2, 3, 4)), media.full(b"co64", struct.pack(">IQQ", 2, 12, 8)))
    stored = media.box(b"mdat", body) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", table))))
    assert media.samples(stored) == b"AABBBCCCC"
    assert [(k["offset"], k["length"]) for k in media.describe(stored)["keyframes"]] == [(12, 2), (14, 3), (8, 4)]


def test_op5(spark):
    got = {r.doc_id: r for r in queries.op5_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        payload, r = media.padded(d.text), got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.write(payload)), hashlib.sha256(media.write(payload)).hexdigest())


def test_op5_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a", 3), (1, "a", 3)], "doc_id long, text string, media int")
    out = media.read_payload(media.media_info(media.store_text(df)))
    assert sorted(bytes(r.payload) for r in out.collect()) == sorted([b" " * 192, b" " * 192, b"a" + b" " * 191, b"a" + b" " * 191])
    assert media.store_text(df.limit(0)).count() == 0


def test_op6_as_sql(spark):
    assert_same(queries.op6_mixing(spark, SF), queries.ORACLE_SQL["op6_mixing"], SF)


def test_op6_with_many_rounds(spark, monkeypatch):
    """Ranges dealt again and again, and sources in several ranges, give the same."""
    want = sorted(map(tuple, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"]).collect()))
    monkeypatch.setattr(mixing, "SORTED", 1)
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), range_bits=2, keep=["doc_id"])
    assert sorted(map(tuple, got.collect())) == want
    rows = [(None, "a b c", "s")] * 50 + [(k, "d " * k, "s") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, range_bits=3).collect()
    assert abs(sum(r.taken for r in out) - out[0].target) < 51 and all(r.taken <= 2 * r.size for r in out)


def test_op6_targets_by_brute_force(spark):
    """Uneven sources stop one after another; all may stop, and all may be empty."""
    for sizes, share, cap in (([1, 10, 100, 1000, 10**4, 10**5, 5], 1.5, 2.0), ([3, 3], 3.0, 2.0), ([0, 0], 1.5, 2.0), ([7], 1.5, 2.0), (list(range(40)), 1.9, 2.0)):
        names = [None if k == 2 else f"s{k:02d}" for k in range(len(sizes))]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), share, cap).collect()}
        order = sorted(names, key=lambda s: (s is None, s or ""))
        size = dict(zip(names, sizes, strict=True))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        left, free, want = share * sum(sizes), set(names), {}
        while free:
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if cap * size[s] <= level * weight[s]}
            if not full:
                want |= {s: level * weight[s] for s in free}
                break
            want |= {s: cap * size[s] for s in full}
            left -= sum(cap * size[s] for s in full)
            free -= full
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_op6_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "d e", None), (3, "", "y"), (4, "p " * 500, "z"), (5, "q\tr\x0bs", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sums[r.source] = sums.get(r.source, 0) + r.taken
    for r in got:
        assert abs(sums[r.source] - r.target) <= 2
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    made = mixing.copies(out).collect()
    assert sum(len(r.text.split()) for r in made) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_reshare(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("d", 400), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 0}, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    want, excess, free = dict.fromkeys(size, 0.0), 1.5 * 1415, set(size)
    while excess > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            want[s] += excess * weight[s] / total
        excess = sum(max(0, want[s] - 2 * size[s]) for s in size)
        want = {s: min(want[s], 2 * size[s]) for s in size}
        free = {s for s in free if want[s] < 2 * size[s] - 1e-9}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in size)
