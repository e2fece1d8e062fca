"""Character n-gram metrics, each in a native form and as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.text import PUNCTUATION, grams, let, without


def f_score(p: Column, r: Column, beta: float) -> Column:
    return F.when(p + r > 0, (1 + beta * beta) * p * r / F.nullif(beta * beta * p + r, F.lit(0.0))).otherwise(0.0)


#: Rows and code points of a block, and the factor of n-grams' hashes.
ROWS, POINTS, FACTOR = 256, 1 << 20, np.uint64(0x9E3779B97F4A7C15)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of at most ROWS rows and POINTS code points, one row at least."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = min(start + ROWS, max(start + 1, int(np.searchsorted(ends, base + POINTS, side="right"))))
        yield start, stop
        start = stop


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def overlaps(predictions: list[str], references: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest x rows, 2 x rows): for each order the common n-grams, each as often as on the side that has fewer, and the lengths of both sides.

    A block's n-grams of both sides are one array of numbers: row, 55 bits of hash (all of the n-gram for pairs of characters and
    less) and side. Sorted, equal n-grams of a row lie together, and the lesser of their two counts is what they have in common.
    """
    n = len(predictions)
    sizes = np.array([[len(x) for x in predictions], [len(x) for x in references]], np.int64).reshape(2, n)
    common = np.zeros((longest, n), np.int64)
    for start, stop in _blocks(sizes.sum(axis=0)):
        points = np.frombuffer("".join([*predictions[start:stop], *references[start:stop]]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        of = sizes[:, start:stop].ravel()
        side_row = np.repeat(np.arange(2 * (stop - start), dtype=np.uint64), of)
        left = np.repeat(np.cumsum(of), of) - np.arange(len(points))  # code points from here to the text's end
        side, row = side_row // np.uint64(stop - start), side_row % np.uint64(stop - start)
        name = (row << np.uint64(56)) | side
        h = np.zeros(len(points), np.uint64)
        for k in range(longest):
            h = (h[: len(points) - k] << np.uint64(21) if k < 2 else h[: len(points) - k] * FACTOR) + points[k:]
            inside = left[: len(h)] > k
            gram = h[inside] if k < 2 else _spread(h[inside]) >> np.uint64(9)
            keys = np.sort(name[: len(h)][inside] | (gram << np.uint64(1)))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            count, kinds = np.diff(np.append(first, len(keys))), keys[first]
            both = np.flatnonzero((kinds[1:] >> np.uint64(1)) == (kinds[:-1] >> np.uint64(1)))
            common[k, start:stop] = np.bincount((kinds[both] >> np.uint64(56)).astype(np.int64), np.minimum(count[both], count[both + 1]), stop - start)
    return common, sizes


def chrf_values(common: np.ndarray, sizes: np.ndarray, beta: float = 2.0) -> np.ndarray:
    """Mean over orders of the F-score of clipped n-gram overlap; orders that either side lacks don't count."""
    total, orders = np.zeros(common.shape[1]), np.zeros(common.shape[1], np.int64)
    for k, shared in enumerate(common):
        a, b = np.maximum(sizes - k, 0)
        there = (a > 0) & (b > 0)
        p, r = shared / np.maximum(a, 1), shared / np.maximum(b, 1)
        total += np.where(there & (shared > 0), (1 + beta * beta) * p * r / np.where(shared > 0, beta * beta * p + r, 1), 0.0)
        orders += there
    return total / np.maximum(orders, 1)


def bag_f1s(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """F1 of character bags."""
    return 2 * common[0] / np.maximum(sizes.sum(axis=0), 1)


def chrf(prediction: Column, reference: Column, beta: float = 2.0, longest: int = 6) -> Column:
    """Arrow form: no shuffle, one pass over the rows, a batch's n-grams in numpy."""

    @F.pandas_udf("double")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(chrf_values(*overlaps(p.fillna("").tolist(), r.fillna("").tolist(), longest), beta), dtype="float64")

    return run(prediction, reference)


#: Code points of a word, the bits of each (its number plus one), and those of the last. A text's end is 0.
WORD, BITS, LAST = 3, 21, (1 << 21) - 1


def _points(texts: Column, words: int) -> Column:
    """Code points of all texts, behind each text the zeros that its last character's words need."""

    def points(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long") + 1))

    return F.flatten(F.transform(texts, lambda t: F.concat(points(t), F.array_repeat(F.lit(0).cast("long"), WORD * words))))


def _words(points: Column) -> Column:
    """The word that begins at each place."""
    return F.transform(F.sequence(F.lit(0), F.size(points) - WORD), lambda i: F.shiftleft(points[i], 2 * BITS) + F.shiftleft(points[i + 1], BITS) + points[i + 2])


def _entries(points: Column, word: Column, words: int, side: int) -> Column:
    """For each character the words from it on, and its side."""
    places = F.filter(F.sequence(F.lit(0), F.size(points) - WORD * words), lambda i: points[i] != 0)
    return F.transform(places, lambda i: F.struct(*[word[i + WORD * k].alias(f"w{k}") for k in range(words)], F.lit(side).alias("side")))


def _shared(x: Column, y: Column, words: int) -> Column:
    """With how many equal characters two entries begin, none behind a text's end."""
    pairs = [(x[f"w{k}"], y[f"w{k}"]) for k in range(words)]
    filled = [F.when(a.bitwiseAND(LAST) != 0, 3).when(a.bitwiseAND(LAST << BITS) != 0, 2).when(a != 0, 1).otherwise(0) for a, _ in pairs]
    shared = sum(filled[1:], filled[0])  # equal to the ends of both texts, or in all words
    for k, (a, b) in reversed(list(enumerate(pairs))):
        differ = a.bitwiseXOR(b)
        shared = F.when(a != b, F.when(F.shiftright(differ, 2 * BITS) != 0, WORD * k).when(F.shiftright(differ, BITS) != 0, WORD * k + 1).otherwise(WORD * k + 2)).otherwise(shared)
    return shared


def _common(steps: Column, n: int) -> Column:
    """Common n-grams: all entries but those that one side has more among equal ones, halved. A text's last n - 1 entries are unlike any other."""
    held = lambda rest, more: F.struct(rest.alias("rest"), more.alias("more"))
    side = lambda step: F.when(step > 0, 1).otherwise(-1)
    with_step = lambda h, step: F.when(F.abs(step) > n, held(h["rest"], h["more"] + side(step))).otherwise(held(h["rest"] + F.abs(h["more"]), side(step)))
    rest = F.aggregate(steps, held(F.lit(0), F.lit(0)), with_step, lambda h: h["rest"] + F.abs(h["more"]))
    return F.shiftright(F.size(steps) - rest, 1)


def chrf_native(df: DataFrame, keys: list[str], prediction: str, reference: str, beta: float = 2.0, longest: int = 6, name: str = "chrf") -> DataFrame:
    """(keys..., name), inside the JVM: the places of a key's texts are sorted once by the characters from each on.

    Equal n-grams of all orders then lie together, and what an entry has in common with the one before tells where they begin.
    Only texts go through an exchange. ``keys`` should be unique: the n-grams of a repeated key's texts count together, in one row.
    """
    words = -(-longest // WORD)
    sides, orders = {"_p": prediction, "_r": reference}, range(1, longest + 1)
    texts = df.groupBy(*keys).agg(*[F.collect_list(F.coalesce(c, F.lit(""))).alias(s) for s, c in sides.items()])
    # Each array that later expressions name several times is a column of its own, so that it is computed once.
    points = texts.select("*", *[_points(F.col(s), words).alias(f"{s}_points") for s in sides])
    placed = points.select("*", *[_words(F.col(f"{s}_points")).alias(f"{s}_words") for s in sides])
    entries = [_entries(F.col(f"{s}_points"), F.col(f"{s}_words"), words, side) for s, side in zip(sides, (1, -1), strict=True)]
    ordered = placed.select(*keys, *sides, F.sort_array(F.concat(*entries)).alias("_s"))
    step = lambda x, i: F.when(i == 0, 1).otherwise(_shared(x, F.col("_s")[i - 1], words) + 1) * x["side"]
    steps = ordered.select(*keys, *sides, F.transform("_s", step).alias("_steps"))
    size = lambda s, n: F.aggregate(s, F.lit(0).cast("long"), lambda held, t: held + F.greatest(F.char_length(t) - (n - 1), F.lit(0)))
    counts = steps.select(*keys, "_p", F.array(*[F.struct(_common(F.col("_steps"), n).alias("common"), *[size(s, n).alias(s) for s in sides]) for n in orders]).alias("_n"))
    f = F.transform(F.filter("_n", lambda x: (x["_p"] > 0) & (x["_r"] > 0)), lambda x: f_score(x["common"] / x["_p"], x["common"] / x["_r"], beta))
    mean = F.aggregate(f, F.lit(0.0), lambda held, x: held + x) / F.nullif(F.size(f), F.lit(0))
    scored = counts.select(*keys, "_p", F.coalesce(mean, F.lit(0.0)).alias(name))
    return scored.select(*keys, name, F.explode("_p")).select(*keys, name)


@F.pandas_udf(T.DoubleType())
def char_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Arrow form: each text is counted once, where the native form looks for every distinct character in both."""
    return pd.Series(bag_f1s(*overlaps(prediction.fillna("").tolist(), reference.fillna("").tolist(), 1)), dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("chrf", T.DoubleType()), T.StructField("char_f1", T.DoubleType())]))
def pair_scores(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Both scores of a pair in one transfer; null where either text is."""
    found = overlaps(prediction.fillna("").tolist(), reference.fillna("").tolist(), 6)
    there = (prediction.notna() & reference.notna()).to_numpy()
    return pd.DataFrame({"chrf": np.where(there, chrf_values(*found), np.nan), "char_f1": np.where(there, bag_f1s(*found), np.nan)})


def char_f1_native(prediction: Column, reference: Column) -> Column:
    """F1 of character bags, in one expression: distinct characters of the prediction and their counts on both sides."""
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, c))

    def scored(common: Column, p: Column, r: Column) -> Column:
        return F.coalesce(f_score(common / F.nullif(p, F.lit(0)), common / F.nullif(r, F.lit(0)), 1.0), F.lit(0.0))

    def bags(p: Column, r: Column) -> Column:
        common = F.aggregate(F.array_distinct(grams(p, 1)), F.lit(0), lambda acc, c: acc + F.least(count(p, c), count(r, c)))
        return let(scored, common=common, p=F.char_length(p), r=F.char_length(r))

    return let(bags, p=prediction, r=reference)


def mark_places(text: Column, marks: str = PUNCTUATION) -> Column:
    """Distinct places of marks: the number of other characters before, less one (-1 for a leading mark)."""

    def places(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: (F.char_length(t) > 0) & (F.instr(F.lit(marks), F.substring(t, i, F.lit(1))) > 0))
        return F.array_distinct(F.transform(at, lambda i: F.char_length(without(F.substring(t, F.lit(1), i), marks)) - 1))

    return let(places, t=text)


def mark_f1(prediction: Column, reference: Column, marks: str = PUNCTUATION) -> Column:
    """F1 of places of marks, whichever mark it is; 1 if neither text has any."""

    def scored(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        p, r = common / F.nullif(F.size(a), F.lit(0)), common / F.nullif(F.size(b), F.lit(0))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(f_score(F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0)), 1.0), F.lit(0.0)))

    return let(scored, a=mark_places(prediction, marks), b=mark_places(reference, marks))
