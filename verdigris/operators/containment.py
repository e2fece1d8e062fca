"""Which of many given parts are in which texts of a corpus: an index of rolling hashes, in one reading of the corpus.

A part is known by its beginning, the longest of 1, 2, 4, 8... bytes that it has. Hashes of the beginnings set bits of a Bloom
filter of bounded size, the one thing that goes to every executor. A text's windows of these few sizes have their hashes from prefix
sums; a window that the filter lets pass is a candidate, with the bytes that a part may go on with. Candidates meet parts
by hash, and the parts' bytes are compared, so the filter and the hashes decide nothing. There may be any number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.tables import small

#: Bits of the filter: so many for a part, at most so many as a power of two, and those that are set for one.
BITS_EACH, MOST_BITS, PROBES = 32, 27, 4
#: Bytes of texts that are looked at together.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


class Rolling:
    """Hashes of windows of bytes, by prefix sums of their values times powers of BASE."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * _powers(BASE, n), dtype=np.uint64)])
        self.back = _powers(pow(BASE, -1, 2**64), n + 1)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window at every place that has ``size`` bytes from it on."""
        last = max(len(self.sums) - size, 0)
        return _spread((self.sums[size:] - self.sums[:last]) * self.back[:last] + np.uint64(size))


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of a hash at one of PROBES: ``bits`` of the hash from another place of it."""
    return (hashes * np.uint64(2 * probe + 1) + (hashes >> np.uint64(32)) * np.uint64(probe)) >> np.uint64(64 - bits)


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where rows begin and the last one ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE bytes of a binary column, whole rows only."""
    ends = _content(batch.column(column))[1][1:]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _size(part: Column) -> Column:
    """Bytes of a part's beginning: the largest power of two that it has."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.octet_length(part).cast("long"))) - 1)


def _indexed(parts: DataFrame) -> DataFrame:
    """(part, size, hash) of distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _content(batch.column(2))
            rolling, sizes = Rolling(data), batch.column(1).to_numpy()
            hashes = np.zeros(len(sizes), np.uint64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                hashes[rows] = rolling.windows(int(size))[offsets[:-1][rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes.view(np.int64))], names=["part", "size", "hash"])

    return parts.select("part", _size(F.col("part")).alias("size"), F.col("part").cast("binary").alias("bytes")).mapInArrow(run, "part string, size int, hash long")


def _filter(indexed: DataFrame, bits: int) -> np.ndarray:
    """The filter's bits, set where the parts are and joined as 64-bit words: at most 2 ** (bits - 6) of them come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_places(hashes, k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = indexed.select("hash").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _candidates(corpus: DataFrame, sizes: list[int], bits: int, found: np.ndarray, text: str, keep: list[str]) -> DataFrame:
    """(keep..., _text, _at, size, hash, _bytes) for each window that the filter lets pass; _text numbers the rows of the corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(found)
    fields = [T.StructField(f"k{i}", corpus.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("_text", T.LongType()), T.StructField("_at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("_bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in _slices(batch, len(keep) + 1):
                data, offsets = _content(part.column(len(keep) + 1))
                rolling, whole = Rolling(data), data.tobytes()
                for size in sizes:
                    hashes = rolling.windows(size)
                    at = np.arange(len(hashes))
                    for k in range(PROBES):
                        place = _places(hashes[at], k, bits)
                        at = at[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
                    row = np.searchsorted(offsets, at, side="right") - 1
                    inside = at + size <= offsets[row + 1]
                    at, row = at[inside], row[inside]
                    if not len(at):
                        continue
                    ends = np.minimum(at + 2 * size - 1, offsets[row + 1])
                    following = [whole[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(rows) for k in range(len(keep) + 1)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(following, pa.binary())],
                        names=schema.names,
                    )

    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    whole_text = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return corpus.select(*own, F.monotonically_increasing_id().alias("_text"), whole_text.alias("_whole")).mapInArrow(run, schema)


def occurrences(corpus: DataFrame, parts: DataFrame, part: str, text: str, keep: list[str] = ()) -> DataFrame:
    """(keep..., part, hits) of every non-empty part that a text holds: its leftmost occurrences that don't overlap, a row for each part of a text.

    The corpus is read once, whatever the number of parts, and only candidates are shuffled. A part that very many texts hold is a hot
    key of the join only if the parts are too many to be broadcast; Spark then splits its partition.
    """
    keep = list(keep)
    distinct = parts.filter(F.col(part) != "").select(F.col(part).alias("part")).distinct()
    indexed = _indexed(distinct)
    sizes = {r["size"]: r["n"] for r in indexed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each power of two
    bits = min(MOST_BITS, max(12, (BITS_EACH * sum(sizes.values())).bit_length()))
    windows = _candidates(corpus, sorted(sizes), bits, _filter(indexed, bits), text, keep)
    known = small(indexed.select("part", F.col("size").alias("_size"), F.col("hash").alias("_hash"), F.col("part").cast("binary").alias("_part")))
    met = windows.join(known, (F.col("hash") == F.col("_hash")) & (F.col("size") == F.col("_size")))
    same = met.filter(F.substring("_bytes", F.lit(1), F.octet_length("_part")) == F.col("_part"))
    length = F.octet_length("part")
    at = same.groupBy(*[f"k{i}" for i in range(len(keep))], "_text", "part").agg(F.sort_array(F.collect_list("_at")).alias("_places"))
    taken = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("free")),
        lambda so_far, x: F.when(x >= so_far["free"], F.struct((so_far["n"] + 1).alias("n"), (x + length).alias("free"))).otherwise(so_far),
    )
    return at.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "part", taken["n"].alias("hits"))
