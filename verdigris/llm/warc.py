"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.arrow import mapped
from verdigris.llm.store import least_hashed, release, stored

#: Fixed values of the formats.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_URN = "urn:verdigris:page:"
ARCHIVE_BYTES = 8 << 20
#: Bytes of a dictionary and of a record beyond which a frame is taken for damaged; a value of a column holds no more than the latter.
LONGEST_DICTIONARY, LONGEST_RECORD = 64 << 20, (1 << 31) - (1 << 20)

RECORD = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


class WarcError(ValueError):
    """An archive or record whose headers or lengths are wrong."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit that has only the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(uri, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""


def frame_end(data: memoryview, start: int) -> int:
    """End of the Zstandard frame at ``start``, by its header and the sizes of its blocks."""
    try:
        magic, flags = struct.unpack_from("<IB", data, start)
        if magic != FRAME:
            raise WarcError(f"no frame but {magic:#x}")
        single = flags >> 5 & 1
        at = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            last = bool(head & 1)
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    except (struct.error, IndexError) as e:
        raise WarcError("a frame is cut short") from e
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise WarcError("a frame is cut short")
    return at


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    found = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:60]!r}")
        found[name.strip().lower()] = value.strip()
    return first, found


def parse(raw: bytes) -> dict:
    """A record's fields, its headers, lengths and (of a response) its digest checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, field = headers(head)
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in field:
            raise WarcError(f"no {name}")
    if not field["content-length"].isdigit() or rest[int(field["content-length"]) :] != b"\r\n\r\n":
        raise WarcError(f"length {field['content-length']} of {len(rest)} bytes")
    block = rest[: int(field["content-length"])]
    out = {"record_type": field["warc-type"], "record_id": field["warc-record-id"].strip("<>"), "target_uri": field.get("warc-target-uri"), "payload_digest": field.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": field["warc-refers-to"].strip("<>") if "warc-refers-to" in field else None, "error": None}
    if field.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        length = headers(http)[1].get("content-length", "")
        if not mark or not length.isdigit():
            raise WarcError("no HTTP header")
        if out["record_type"] == "response" and int(length) != len(payload) or out["record_type"] == "revisit" and payload:
            raise WarcError(f"payload of {len(payload)} bytes, {length} by its header")
        out |= {"payload_bytes": int(length), "payload": payload if out["record_type"] == "response" else None}
    else:
        out |= {"payload_bytes": len(block), "payload": block}
    if out["payload"] is not None and out["payload_digest"] not in (None, digest(out["payload"])):
        raise WarcError("the payload has another digest")
    if out["record_type"] == "revisit" and not out["refers_to"]:
        raise WarcError("a revisit of nothing")
    return out


def unpacked(reader: zstandard.ZstdDecompressor, frame: memoryview | bytes, most: int) -> bytes:
    """The content of a frame, decoded in steps so that no more than ``most`` bytes are ever held."""
    size = zstandard.frame_content_size(bytes(frame[:18]))
    if size > most:
        raise WarcError(f"a frame of {size} bytes, {most} at most")
    with reader.stream_reader(io.BytesIO(frame)) as stream:
        parts, total = [], 0
        while part := stream.read(1 << 20):
            parts.append(part)
            total += len(part)
            if total > most:
                raise WarcError(f"a frame of over {most} bytes")
    return b"".join(parts)


def records(archive: bytes, most: int = LONGEST_RECORD) -> Iterator[dict]:
    """The records of an archive; after a damaged frame or record, or one of over ``most`` bytes, comes a row with its error."""
    data, at, dictionary = memoryview(archive), 0, b""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        dictionary = bytes(data[8:at])
        if at > len(data):
            yield {"error": "the dictionary is cut short"}
            return
        if dictionary[:4] == struct.pack("<I", FRAME):
            try:
                dictionary = unpacked(zstandard.ZstdDecompressor(), dictionary, LONGEST_DICTIONARY)
            except (WarcError, zstandard.ZstdError) as e:
                yield {"error": f"the dictionary: {e}"}
                return
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        try:
            end = frame_end(data, at)
        except WarcError as e:
            yield {"error": str(e)}
            return
        try:
            yield parse(unpacked(reader, data[at:end], most))
        except (WarcError, zstandard.ZstdError) as e:
            yield {"error": str(e)}
        at = end


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str, most_rows: int = 256, most_bytes: int = 4 << 20, size: int = 32 << 10) -> bytes:
    """A dictionary of at most ``size`` bytes from at most ``most_rows`` whole payloads, those of least hash, of ``most_bytes``
    together; none if they are too few or too short. It changes the archives' size, not their records."""
    whole = pages.filter(F.col(payload_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(payload_col).alias("_payload"), F.octet_length(payload_col).cast("long").alias("_bytes"))
    samples = [r._payload.encode() for r in least_hashed(whole, ["_id", "_payload"], most_rows, size="_bytes", most_size=most_bytes).orderBy(F.xxhash64("_id"), "_id", "_payload").collect()]
    samples += [record("response", RECORD_URN + str(i), "http://www.example.com/", b"") for i in range(8)] if samples else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, level: int = 3) -> DataFrame:
    """Archives (archive_id, content) with a record for each row, stored in the shared folder.

    Of equal payloads of ``least_bytes`` at least, the row of the largest id is a response and rows of
    smaller ids are revisits of it (rows that repeat that id are responses too, and so are groups
    without any id). Null payloads count as empty, a null uri has no header, a null id revisits like a
    smaller one. Nothing but (digest, largest id) of repeated payloads is joined; Spark broadcasts it
    below its own threshold and splits a payload that many rows share beyond.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("_text_id"), F.col(id_col).alias("_id"), F.col(uri_col).alias("_uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload")).withColumn("_sha", F.sha1(F.col("_payload").cast("binary")))
    groups = rows.filter(F.octet_length("_payload") >= least_bytes).groupBy(F.col("_sha").alias("_of")).agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = stored(groups.filter((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_of", "_first"), "warc-repeated")
    typed = rows.join(repeated, F.col("_sha") == F.col("_of"), "left").select("_text_id", "_uri", "_payload", F.when(~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.col("_first").cast("string")).alias("_refers"))
    dictionary = train_dictionary(pages, id_col, payload_col)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_checksum=True)
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}"]), pa.array([dictionary_frame(known) + b"".join(parts)], pa.binary())], names=["archive_id", "content"])

        for batch in batches:
            for page, uri, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                frame = writer.compress(record("response" if refers is None else "revisit", RECORD_URN + (page or ""), uri, payload.encode(), None if refers is None else RECORD_URN + refers))
                if parts and size + len(frame) > ARCHIVE_BYTES:
                    yield archive()
                    number, parts, size = number + 1, [], 0
                parts.append(frame)
                size += len(frame)
        if parts:
            yield archive()

    archives = stored(mapped(typed, run, "archive_id string, content binary"), "warc-archives")
    release(repeated)
    return archives


def read_archives(archives: DataFrame, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """A row for each record of binary archives (also of Spark's binaryFile source); ``error`` says what
    is wrong with a damaged one. Null and empty archives have no records. ``payloads``: False leaves them null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for found in records(content.as_py() or b""):
                    if not payloads:
                        found["payload"] = None
                    rows.append(found)
                    size += len(found.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(archives.select(content_col), run, RECORD)
