"""Objects one after another in files, whatever stands between them, read in many tasks a file.

The sequential reader tries every opening brace in turn, and goes on behind each object that it finds. An object ends with a closing
brace, so Spark's text source, told that lines end with one, cuts a file into pieces between which the reader may have to go on.
Every split of a file is read as if the reader went on at its beginning. That is right but for its first objects, where one may have begun in the
split before: what is left over there and the beginning of the split are read once more, together, until the reader goes on
where the split's own reading did; from there on both agree. A file where that doesn't happen is read by one task.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.tables import scratch, small

#: Characters of a split's beginning that are read once more, and of a rest that a split leaves over; larger objects may ask for one task.
EDGE = 1 << 20

READ = "kind string, file string, block long, length long, size long, seq long, text string, marks array<long>, bytes long, closed boolean"
MET = "kind string, file string, block long, seq long, text string"
_DECODER = json.JSONDecoder()


def _object(text: str, at: int) -> tuple[str, int, bool]:
    """(the object at an opening brace, where it ends, False); without one ("", -1, whether more text could make it one)."""
    try:
        value, end = _DECODER.raw_decode(text, at)
        return json.dumps(value, ensure_ascii=False), end, False
    except json.JSONDecodeError as e:
        # an open string, or an error among the last characters, which may be half a word, number or escape
        return "", -1, e.msg.startswith("Unterminated string") or e.pos >= len(text) - 12
    except RecursionError:
        return "", -1, False


def objects(text: str) -> Iterator[str]:
    """The sequential reader."""
    at = 0
    while (at := text.find("{", at)) >= 0:
        found, end, _ = _object(text, at)
        if end < 0:
            at += 1
        else:
            yield found
            at = end


def _split(text: str, last: bool) -> tuple[list[str], list[int], str]:
    """The objects of a split read from its beginning; where the reader went on and the brace that it found its next object at (the rest or the end, if
    none), one pair after another; and the rest from a brace on that may belong to an object which ends in the next split."""
    found, gaps, at = [], [0], 0
    while (at := text.find("{", at)) >= 0:
        value, end, open_ = _object(text, at)
        if end >= 0:
            found.append(value)
            gaps += [at, end]
            at = end
        elif open_ and not last:
            return found, [*gaps, at], text[at:]
        else:
            at += 1
    return found, [*gaps, len(text)], ""


def _meeting(rest: str, head: str, whole: bool, gaps: list[int]) -> tuple[list[str], int, int] | None:
    """The objects from ``rest`` on up to where the reader goes on in a gap between objects of the next split's own reading, the number of its objects before
    that gap, and the place in its text ``head``; None if the head, unless it is the ``whole`` rest of the file, ends before."""
    text, found, at = rest + head, [], 0
    while True:
        brace = text.find("{", at)
        if at <= len(rest) and not len(rest) > brace >= 0:
            return found, 0, 0
        place = at - len(rest)
        k = bisect_right(gaps[::2], place) - 1
        if place > 0 and gaps[2 * k] <= place <= gaps[2 * k + 1]:
            return found, k, place
        if brace < 0:
            return None
        value, end, open_ = _object(text, brace)
        if end >= 0:
            found.append(value)
            at = end
        elif open_ and not whole:
            return None
        else:
            at = brace + 1


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of READ: the objects of each split, and one row about its edges."""
    now: tuple | None = None
    parts: list[str] = []
    bytes_ = 0

    def close() -> Iterator[pd.DataFrame]:
        file, block, length, size = now
        last = block + length >= size
        text = "}".join([*parts, ""])
        found, gaps, rest = _split(text, last)
        objects_ = [("object", file, block, length, size, k, value, None, 0, False) for k, value in enumerate(found)]
        head = text[:EDGE]
        inside = [x for k in range(0, len(gaps), 2) if gaps[k] <= EDGE for x in gaps[k : k + 2]]
        # the head and the rest in one text: the head's length is the first mark
        edge = ("edge" if len(rest) <= EDGE else "large", file, block, length, size, int(last and len(text) <= EDGE), head + rest[:EDGE], [len(head), *inside], bytes_, bool(found) and gaps[-2] == len(text))
        for start in range(0, len(objects_), 5000):
            yield pd.DataFrame(objects_[start : start + 5000], columns=_names(READ))
        yield pd.DataFrame([edge], columns=_names(READ))

    for batch in batches:
        for value, *name, n in zip(*(batch[c] for c in ("value", "file", "block", "length", "size", "n")), strict=True):
            if tuple(name) != now:
                if now is not None:
                    yield from close()
                now, parts, bytes_ = tuple(name), [], 0
            parts.append(value)
            bytes_ += n + 1
    if now is not None:
        yield from close()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of MET: for each split but a file's first the objects across its beginning, and how many of its own belong to none."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            found = None
            if r.kind == "edge" and isinstance(r.next_text, str):
                rest, head = r.text[r.marks[0] :], r.next_text[: r.next_marks[0]]
                found = _meeting(rest, head, bool(r.next_whole), [int(m) for m in r.next_marks[1:]])
            if found is None:
                out.append(("lost", r.file, r.block, 0, ""))
            else:
                across, first, place = found
                out.append(("from", r.file, r.block + r.length, first, ""))
                out += [("object", r.file, r.block + r.length, k, value) for k, value in enumerate(across)]
                if across and r.next_whole and place == len(head):
                    out.append(("closed", r.file, r.block, 0, ""))
        yield pd.DataFrame(out, columns=_names(MET))


def concatenated_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The objects of files, as rows of ``schema``; a file is as many tasks as Spark makes splits of it (spark.sql.files.maxPartitionBytes)."""
    about = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size")]
    pieces = spark.read.option("lineSep", "}").text(path).select("value", *about, F.octet_length("value").cast("long").alias("n"))
    place = scratch(spark, "concatenated")
    pieces.mapInPandas(_read, READ).write.parquet(place)
    read = spark.read.schema(READ).parquet(place)
    edges = read.filter("kind <> 'object'")
    after = edges.select(F.col("file").alias("next_file"), F.col("block").alias("next_block"), F.col("text").alias("next_text"), F.col("marks").alias("next_marks"), F.col("seq").alias("next_whole"))
    pairs = edges.filter("block + length < size").join(after, (F.col("file") == F.col("next_file")) & (F.col("block") + F.col("length") == F.col("next_block")), "left")
    met_place = scratch(spark, "concatenated")
    pairs.select("kind", "file", "block", "length", "text", "marks", "next_text", "next_marks", "next_whole").mapInPandas(_met, MET).write.parquet(met_place)
    met = spark.read.schema(MET).parquet(met_place)
    # a closing brace was added to what stands behind a file's last one; it must not have closed an object
    last = (F.col("block") + F.col("length") >= F.col("size")) & F.col("closed")
    behind = edges.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.bool_or(last).alias("closed")).filter("bytes > size")
    open_ends = behind.filter("closed").select("file").union(behind.join(met.filter("kind = 'closed'").select("file"), "file", "left_semi").select("file"))
    odd = small(met.filter("kind = 'lost'").select("file").union(open_ends).distinct())
    begin = met.filter("kind = 'from'").select("file", "block", F.col("seq").alias("first"))
    own = read.filter("kind = 'object'").join(small(begin), ["file", "block"], "left").filter("seq >= coalesce(first, 0)").select("file", "text")
    even = own.union(met.filter("kind = 'object'").select("file", "text")).join(odd, "file", "left_anti").select("text")
    whole = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file")).join(odd, "file", "left_semi")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": [value for text in batch["value"] for value in objects(text)]}, dtype="object")

    rows = even
    if not odd.isEmpty():
        rows = even.union(whole.select("value").mapInPandas(alone, "text string"))
    return rows.select(F.from_json("text", schema).alias("v")).select("v.*")
