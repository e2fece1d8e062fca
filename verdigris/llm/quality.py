"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.llm.arrow import trim, with_columns
from verdigris.llm.store import least_hashed, release, stored
from verdigris.llm.words import LOWER, mix, words

BITS = 18
#: Stands for every pair of a word and itself.
REPEATED = np.uint64(0xABCDEF0123456789)
#: Letters and digits make words, and so do runs of other signs: a table's bars or a row of stars are words too.
KINDS = np.full(256, 2, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, hashed places and values of each text's vector: counts of words and word pairs, of length 1."""
    found = words(column, change=LOWER.__getitem__, kinds=KINDS)
    pairs, first, pair_bounds = found.windows(2)
    pairs = np.where(found.hashes[first] == found.hashes[first + 1], REPEATED, pairs)
    n = len(found.bounds) - 1
    row = np.concatenate([found.rows(), np.repeat(np.arange(n), np.diff(pair_bounds))]).astype(np.uint64)
    place = np.concatenate([mix(found.hashes ^ np.uint64(1)), pairs]) >> np.uint64(64 - BITS)
    key, count = np.unique((row << np.uint64(BITS)) | place, return_counts=True)
    row = (key >> np.uint64(BITS)).astype(np.int64)
    value = np.sqrt(count)
    length = np.sqrt(np.bincount(row, value * value, minlength=n)) if n else np.zeros(0)
    return np.searchsorted(row, np.arange(n + 1)), (key & np.uint64((1 << BITS) - 1)).astype(np.int32), (value / length[row]).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, passes: int = 3) -> np.ndarray:
    """Weights, the bias last. One update an example: z and n of its places follow the gradient, and a
    weight is the proximal minimiser, 0 while |z| is at most l1."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for place, value, label in examples:
            at, x = np.append(place, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Trains on at most ``most_rows`` rows of ``labels``, those of least hash, and of them on those whose vectors
    have ``most_bytes`` together; null labels and ids don't count.

    These bounds keep the examples in the driver's memory; their texts are whole. Rows that repeat an id
    count each. Without labelled rows all weights are 0 (every score 0.5).
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = least_hashed(known, ["_id", "_label"], most_rows)
    pairs = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text")

    def make(batch: pa.RecordBatch) -> list:
        bounds, place, value = features(batch.column("_text"))
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [pa.array(cut(place), pa.binary()), pa.array(cut(value), pa.binary())]

    vectors = stored(with_columns(pairs, "_text", [T.StructField("_place", T.BinaryType()), T.StructField("_value", T.BinaryType())], make, ["_id", "_label"]), "quality-vectors")
    order = [F.xxhash64("_id"), "_id", "_label", "_place"]
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the sample's rows
    rows = vectors.withColumn("_so_far", F.sum(F.octet_length("_place") + F.octet_length("_value")).over(so_far)).filter(F.col("_so_far") <= most_bytes).orderBy(*order).collect()
    release(vectors)
    found = train([(np.frombuffer(r._place, np.int32), np.frombuffer(r._value, np.float32), r._label) for r in rows])
    del rows
    trim()
    return found


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score_col``, the probability of label 1 of the whole text. Null and empty texts have the
    bias's score. Every row stands for itself: repeated rows have equal scores, ids play no part, very long texts are read
    whole, and an empty table gives no rows. Other columns stay; one of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make(batch: pa.RecordBatch) -> list:
        w = shared.value
        bounds, place, value = features(batch.column(text_col))
        sums = np.concatenate([[0.0], np.cumsum(w[place].astype(np.float64) * value)])
        return [pa.array(1 / (1 + np.exp(-(sums[bounds[1:]] - sums[bounds[:-1]] + w[-1]))), pa.float64())]

    return with_columns(df, text_col, [T.StructField(score_col, T.DoubleType())], make, keep)
