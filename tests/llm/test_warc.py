import base64
import hashlib
from collections import defaultdict

import zstandard

from tests.llm.util import assert_same
from verdigris.llm import queries, warc

SF = "/root/testdata/sf0.001"


def test_query_as_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    groups = defaultdict(list)
    for p in pages:
        groups[p.html or ""].append(p.page_id)
    got = {r.page_id: r for r in queries.op8_warc(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        raw, r, first = (p.html or "").encode(), got[p.page_id], max(groups[p.html or ""])
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to, r.error) == (("response", None) if p.page_id == first else ("revisit", first)) + (None,)


def test_query_as_sql(spark):
    assert_same(queries.op8_warc(spark, SF), queries.ORACLE_SQL["op8_warc"], SF)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 300000, "http://e/ü\r\nX: y"), (4, "dup", None), (5, "dup", "c"), (5, "dup", "c"), (None, "dup", "d"), (None, "alone", "e")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").repartition(3)
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.error) for r in warc.read_archives(warc.write_archives(df)).collect())
    urn = warc.RECORD_URN
    assert got == sorted(
        [(urn + "1", "revisit", urn + "2", 0, None), (urn + "2", "response", "", 0, None), (urn + "3", "response", "", 300000, None), (urn + "4", "revisit", urn + "5", 3, None), (urn + "5", "response", "", 3, None), (urn + "5", "response", "", 3, None), (urn, "revisit", urn + "5", 3, None), (urn, "response", "", 5, None)]
    )
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    least = warc.read_archives(warc.write_archives(df, least_bytes=4)).filter("record_type = 'revisit'")
    assert least.count() == 0


def test_query_with_null_ids(spark, tmp_path):
    rows = [(None, "a", "u"), (None, "a", None), (7, "a", "u"), (6, None, "u"), (None, None, None), (8, "b", "u")]
    spark.createDataFrame(rows, "page_id long, html string, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.record_type, r.refers_to, r.error) for r in queries.op8_warc(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or 0)
    assert sorted(got, key=key) == sorted([(None, "revisit", 7, None), (None, "revisit", 7, None), (7, "response", None, None), (6, "response", None, None), (None, "revisit", 6, None), (8, "response", None, None)], key=key)


def test_frames_are_bounded():
    good, long = warc.record("response", "urn:x:1", "http://a/", b"hello"), warc.record("response", "urn:x:2", "http://a/", bytes(50 << 20))
    archive = build(b"", [good, long, good])
    assert len(archive) < 20_000
    assert [f["error"] is None for f in warc.records(archive, 1 << 20)] == [True, False, True]
    assert [f["error"] is None for f in warc.records(archive)] == [True, True, True]
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(long)
    assert [f["error"] is None for f in warc.records(unsized + build(b"", [good]), 1 << 20)] == [False, True]
    bomb = warc.dictionary_frame(zstandard.compress(bytes(warc.LONGEST_DICTIONARY + 1)))
    assert "dictionary" in next(warc.records(bomb + build(b"", [good])))["error"]


def build(dictionary, raws):
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(writer.compress(r) for r in raws)


def test_frames_and_dictionary():
    raws = [warc.record("response", f"urn:x:{i}", "http://a/", b"payload %d " % i * (1 + i * 50)) for i in range(40)] + [warc.record("response", "urn:big", None, bytes(range(256)) * 3000)]
    dictionary = zstandard.train_dictionary(2048, raws[:20] * 8).as_bytes()
    for known in (b"", dictionary):
        found = list(warc.records(build(known, raws)))
        assert [f["error"] for f in found] == [None] * 41 and found[40]["payload"] == bytes(range(256)) * 3000
    packed = warc.dictionary_frame(zstandard.compress(dictionary)) + build(dictionary, raws)[len(warc.dictionary_frame(dictionary)) :]
    assert [f["error"] for f in warc.records(packed)] == [None] * 41


def test_damage_is_reported():
    good = warc.record("response", "urn:x:1", "http://a/", b"hello")
    for bad in (good.replace(b"hello", b"hellx"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good[:-2], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"Some-Date"), b""):
        found = list(warc.records(build(b"", [bad, good])))
        assert found[0]["error"] and found[1]["error"] is None
    whole = build(b"", [good, good])
    assert [f["error"] is None for f in warc.records(whole[:-3])] == [True, False]
    assert [f["error"] is None for f in warc.records(whole + b"junk!")] == [True, True, False]
