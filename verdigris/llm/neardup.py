"""Near-duplicate documents by SetSketch registers.

A register is the exponentially spaced, truncated minimum of one random function over a set's
shingles. Bands of registers find candidates, the likelihood of a pair's registers drops hopeless
ones, and full sets confirm the rest. Documents with equal sets are one class, and only class
representatives are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.llm.arrow import mapped, slices, with_columns
from verdigris.llm.components import components
from verdigris.llm.store import release, small, stored
from verdigris.llm.words import mix, words

#: 20 bands of 3 registers miss a pair of similarity 0.85 once in 100 million, one of 0.8 once in 1.7 million.
BANDS, ROWS = 20, 3
REGISTERS = BANDS * ROWS
#: Base, rate and largest value of the registers.
SPACING, RATE, LAST = 1.001, 20.0, 65535
#: Log-likelihood by which a pair must be better explained by less similarity to be dropped: over 5 standard errors.
UNLIKELY = 14.0
#: Rows of a bucket compared in one task.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000
#: Pairs whose registers are held at once.
PAIRS = 150_000
_MULTIPLY = np.random.default_rng(85).integers(1, 2**62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(86).integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by row, and the bounds by row. A text of fewer words is one shingle, one without words none."""
    found = words(column, lower=True)
    hashes, _, bounds = found.windows(size)
    count = np.diff(found.bounds)
    row = np.repeat(np.arange(len(count)), np.diff(bounds))
    for n in range(1, size):
        brief = np.flatnonzero(count == n)
        if len(brief):
            whole = np.zeros(len(brief), np.uint64)
            for j in range(n):
                whole = mix(whole + found.hashes[found.bounds[brief] + j] + np.uint64(n))
            hashes, row = np.concatenate([hashes, whole]), np.concatenate([row, brief])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each non-empty row: floor(1 - log_b(x)) of the least of exponential values x, within 0 and LAST."""
    least = np.full((len(bounds) - 1, REGISTERS), 2.0**32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    step = 1 << 16
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(hashes), step):  # blocks that fit the cache
        h, r = hashes[a : a + step], rows[a : a + step]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for k in range(REGISTERS):
            value = ((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            low = np.minimum.reduceat(value, first)
            least[r[first], k] = np.minimum(least[r[first], k], low)
    unit = (least[full] + 0.5) / 2.0**32
    x = -np.log1p(-unit) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(SPACING)), 0, LAST).astype(np.uint16)


def unlikely(equal: np.ndarray, more: np.ndarray, fewer: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether counts of equal, greater and smaller registers of two sets of known sizes speak clearly against similarity ``threshold`` or more."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 1e-9, 1) * (SPACING - 1) / SPACING) / np.log(SPACING), 1e-9, 1)

    best = np.full((2, len(equal)), -np.inf)
    for j in np.linspace(0.0, 1.0, 41):
        high, low = chance(u - v * j), chance(v - u * j)
        like = more * np.log(high) + fewer * np.log(low) + equal * np.log(np.clip(1 - high - low, 1e-9, 1))
        possible = (u - v * j >= -0.02) & (v - u * j >= -0.02)
        k = int(j >= threshold - 0.013)
        best[k] = np.where(possible, np.maximum(best[k], like), best[k])
    return best[1] < best[0] - UNLIKELY


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, sketch): the size of a set, an order-free hash of it, and its registers (null for the empty set)."""

    def make(batch: pa.RecordBatch) -> list:
        hashes, bounds = shingles(batch.column(text_col), size)
        count = np.diff(bounds)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (11, 12)]
        keys = [(s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums]
        registers, full = iter(sketch(hashes, bounds)), count > 0
        return [pa.array(count.astype(np.int64)), *map(pa.array, keys), pa.array([next(registers).tobytes() if ok else None for ok in full], pa.binary())]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return with_columns(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), text_col, fields, make, ["id"])


def band_keys(registers: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The bucket of ROWS registers, the last axis, in a band."""
    key = np.zeros(registers.shape[:-1], np.uint64) + band.astype(np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(65537) + registers[..., k].astype(np.uint64))
    return key.astype(np.int64)


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, id) for each band of a representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), BANDS, ROWS)
            key = band_keys(registers, np.arange(BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, BANDS))], names=["bucket", "id"])

    return mapped(reps.select("id", "sketch"), run, "bucket long, id long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets, from texts (id, text), have 100 * intersection >= percent * union."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b").select("a", "b", "_ta", "_tb")

    def make(batch: pa.RecordBatch) -> list:
        sides = [shingles(batch.column(c), size) for c in ("_ta", "_tb")]
        n = batch.num_rows
        owner = [np.repeat(np.arange(n, dtype=np.uint64), np.diff(b)) for _, b in sides]
        keys = np.concatenate([mix(h + mix(o)) for (h, _), o in zip(sides, owner, strict=True)])
        order = np.argsort(keys)
        twice = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        common = np.bincount(np.concatenate(owner)[order[twice]].astype(np.int64), minlength=n)
        total = sum(np.diff(b) for _, b in sides)
        return [pa.array((100 * common >= percent * (total - common)) & (common > 0))]

    return with_columns(both, "_ta", [T.StructField("_linked", T.BooleanType())], make, ["a", "b"], also=("_tb",)).filter("_linked").select("a", "b")


def _dealt(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Comparison tasks from (bucket, id, component, n_shingles, ...): rows with (left, right, side), sorted by task.

    Of each bucket the largest component is dealt into chunks, each seen by one task; the other rows go
    to every chunk, and among themselves in pairs of chunks. No task sees more than two chunks, and
    pairs within a component are never made. ``made`` gets the stored table that the result reads.
    """
    per = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    totals = per.groupBy("bucket").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > top.n")
    chunks = lambda n, s: F.greatest(F.ceil(n / CHUNK), F.ceil(s / CHUNK_SHINGLES), F.lit(1)).cast("int")
    totals = stored(totals.select("bucket", F.col("top.component").alias("major"), chunks(F.col("top.n"), F.col("top.s")).alias("majors"), chunks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("minors")), "near-totals")
    made.append(totals)
    dealt = rows.join(totals, "bucket").withColumn("is_major", F.col("component") == F.col("major"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    # a task is (left, right): right a chunk of the others, left one of the major (0...) or of the others (-1...)
    own, others = F.col("chunk"), F.sequence(F.lit(0), F.col("minors") - 1)
    major_tasks = F.transform(others, lambda k: F.struct(own.alias("left"), k.alias("right"), F.lit(0).alias("side")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda k: F.struct(k.alias("left"), own.alias("right"), F.lit(1).alias("side")))
    among = F.transform(others, lambda k: F.struct((-1 - F.least(own, k)).alias("left"), F.greatest(own, k).alias("right"), F.when(own <= k, 0).otherwise(1).alias("side")))
    tasks = dealt.withColumn("task", F.explode(F.when(F.col("is_major"), major_tasks).otherwise(F.concat(as_right, among))))
    tasks = tasks.select("bucket", "task.left", "task.right", "task.side", "id", "component", "n_shingles", "sketch", *[c for c in ("text",) if c in rows.columns])
    return tasks.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "side", "id")


def _crowded(rows: DataFrame) -> DataFrame:
    """Stored (bucket): buckets with over CHUNK rows outside their largest component, which would be compared with each other."""
    per = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    return stored(per.groupBy("bucket").agg((F.sum("n") - F.max("n")).alias("others")).filter(F.col("others") > CHUNK).select("bucket"), "near-crowded")


def _by_rare_shingles(rows: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Rows of crowded buckets (bucket, id, component, n_shingles, sketch), each in a bucket of its own for every rare shingle.

    Rows that share a template fill a bucket without being alike. Two sets of the similarity share one of the
    n - ceil(percent n / 100) + 1 rarest shingles of either, whatever the order of rarity, so only rows that share such a
    shingle need be compared: none is missed. Shingles are counted over all rows of crowded buckets.
    """
    each = rows.dropDuplicates(["id"]).select("id", "component", "n_shingles", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = shingles(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), np.diff(bounds))), pa.array(hashes.astype(np.int64))], names=["id", "shingle"])

    found = mapped(texts.join(each.select("id"), "id").select("id", "text"), run, "id long, shingle long")
    shared = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    order = Window.partitionBy("id").orderBy("_n", "shingle")  # as many rows as a text has shingles
    ranked = found.join(shared, "shingle").withColumns({"_place": F.row_number().over(order), "_shared": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    prefix = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1
    rare = ranked.join(each, "id").filter(F.col("_place") + F.col("n_shingles") - F.col("_shared") <= prefix)  # shingles of one row alone are the rarest
    return rare.select(F.xxhash64("shingle").alias("bucket"), "id", "component", "n_shingles", "sketch")


def _cross_links(rows: DataFrame, texts: DataFrame, percent: int, size: int, banded: bool = True) -> DataFrame:
    """Stored links (a, b) that join components within a bucket, from (bucket, id, component, n_shingles, sketch) and (id, text). ``banded``: the buckets are those of bands.

    Sketches alone tell first which rows have a likely partner in which bucket; only these get their
    texts. Pairs are tested where their rows are: no pair leaves a task but the links.
    """
    made: list[DataFrame] = []
    made.append(stored(_compared(_dealt(rows, made), percent, size, banded, tested=False).distinct(), "near-needed"))
    links = stored(_compared(_dealt(rows.join(made[-1], ["bucket", "id"]).join(texts, "id"), made), percent, size, banded, tested=True).distinct(), "near-links")
    release(*made)
    return links


def _likely(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, registers: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, banded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the row pairs (i, j) are of two components, may reach the similarity and, in buckets of bands, share no earlier band than theirs, and how many registers they share."""
    good = (comp[i] != comp[j]) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j]))
    i, j = i[good], j[good]
    equal = registers[i] == registers[j]
    # a pair of 0.8 with fewer than a third of its registers equal is beyond any odds; the likelihood decides on the rest
    good = equal.sum(axis=1) * 3 >= REGISTERS
    i, j, equal = i[good], j[good], equal[good]
    if banded:
        first = equal.reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1)
        good = band_keys(registers[i].reshape(-1, BANDS, ROWS)[np.arange(len(i)), first], first) == bucket[i]
        i, j, equal = i[good], j[good], equal[good]
    more, fewer = (registers[i] > registers[j]).sum(axis=1), (registers[i] < registers[j]).sum(axis=1)
    good = ~unlikely(equal.sum(axis=1), more, fewer, n[i], n[j], percent / 100)
    return i[good], j[good], equal[good].sum(axis=1)


def _joining(found: tuple[np.ndarray, np.ndarray, np.ndarray], comp: np.ndarray, texts: pa.Array, percent: int, size: int) -> list[tuple[int, int]]:
    """Row pairs whose full sets are linked, best estimates first; a pair whose components are already joined here is passed over."""
    i, j, equal = found
    order = np.argsort(-equal, kind="stable")
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    hashes, bounds = shingles(texts.take(pa.array(used)), size)
    sets = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (p := parent.get(c, c)) != c:
            parent[c] = parent.get(p, p)
            c = p
        return c

    out = []
    for k in order.tolist():
        x, y = root(int(comp[i[k]])), root(int(comp[j[k]]))
        if x == y:
            continue
        a, b = sets[where[k]], sets[where[len(i) + k]]
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= percent * (len(a) + len(b) - common):
            parent[max(x, y)] = min(x, y)
            out.append((int(i[k]), int(j[k])))
    return out


def _compared(rows: DataFrame, percent: int, size: int, banded: bool, tested: bool) -> DataFrame:
    """Joining links (a, b) of sorted task rows, or untested the rows (bucket, id) of likely pairs. All tasks of a batch are compared together, in slices of bounded size."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        bucket, left, right, side, ids, comp, n = (table.column(k).to_numpy() for k in range(7))
        registers = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        group = np.cumsum(new) - 1
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(ids)]])
        rights = np.flatnonzero(new) + np.bincount(group, side == 0).astype(np.int64)
        same = left == -1 - right
        start = np.where(same, np.arange(len(ids)) + 1, rights[group])
        count = np.where(side == 0, ends[group] - start, 0)
        links: list[tuple[int, int]] = []
        likely_rows = np.zeros(len(ids), bool)
        total = np.cumsum(count)
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(at, stop), count[at:stop])
            j = np.arange(len(i)) + np.repeat(start[at:stop] - (np.cumsum(count[at:stop]) - count[at:stop]), count[at:stop])
            likely = _likely(ids, comp, n, registers, bucket, i, j, percent, banded)
            if tested and len(likely[0]):
                links += _joining(likely, comp, table.column(8).combine_chunks(), percent, size)
            likely_rows[likely[0]] = likely_rows[likely[1]] = True
            at = stop
        if not tested:
            return pa.RecordBatch.from_arrays([pa.array(bucket[likely_rows]), pa.array(ids[likely_rows])], names=["bucket", "id"])
        a, b = (ids[[link[k] for link in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            # the last task of a batch may go on in the next one
            # (at most two chunks), all others are compared now
            keys = [batch.column(k).to_numpy() for k in range(3)]
            last = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1]) + 1 if any((k != k[-1]).any() for k in keys) else 0
            if last or (waiting and any(waiting[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(3))):
                yield pairs(pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks())
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield pairs(pa.Table.from_batches(waiting).combine_chunks())

    return mapped(rows, run, "a long, b long" if tested else "bucket long, id long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row of ``df``; the first column is named ``id_col``.

    Sets are the distinct ``size``-word shingles of whole texts, A-Z as a-z; a text of fewer words is one
    shingle. Rows are linked when 100 * intersection >= percent * union (80 at least), and a component is named
    by its smallest id. class_id is the smallest id with the same set. Empty sets link with nothing.
    Null ids link with nothing either: their class and component are null and they aren't kept. Rows
    that repeat an id and text have one fate; of other texts with one id, the least is compared for all. Extra columns play no part.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    light = stored(sketches(df, id_col, text_col, size), "near-light")
    linkable = light.filter("id IS NOT NULL AND n_shingles > 0")
    classes = stored(linkable.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id")), "near-classes")
    # one row for each class, though its least id may repeat
    reps = stored(linkable.join(classes, (linkable.set_a == classes.set_a) & (linkable.set_b == classes.set_b) & (linkable.id == classes.class_id)).select("id", "n_shingles", linkable.set_a, linkable.set_b, "sketch").dropDuplicates(["id", "set_a", "set_b"]), "near-reps")
    bands = _bands(reps)
    shared = stored(bands.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("last")).filter("center < last").select("bucket", "center"), "near-buckets")
    bands = stored(bands.join(shared, "bucket"), "near-bands")
    candidates = stored(bands.select("id").distinct(), "near-candidates")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(candidates), "id")
    texts = stored(texts.groupBy("id").agg(F.min("text").alias("text")), "near-texts")
    # round 1: everyone with the least centre among its buckets
    primary = bands.filter("id > center").groupBy(F.col("id").alias("a")).agg(F.min("center").alias("b"))
    links = stored(confirmed(primary, texts, percent, size), "near-links")
    first = components(links)
    # round 2: what is still apart but shares a bucket
    named = stored(bands.select("bucket", "id").join(first, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "near-named")
    mixed = stored(named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket"), "near-mixed")
    apart = named.join(mixed, "bucket").join(reps.select("id", "n_shingles", "sketch"), "id")
    crowded = _crowded(apart)
    some = not crowded.isEmpty()
    crossing = [_cross_links(apart.join(small(crowded), "bucket", "left_anti") if some else apart, texts, percent, size)]
    if some:
        rare = stored(_by_rare_shingles(apart.join(small(crowded), "bucket", "left_semi"), texts, percent, size), "near-rare")
        crossing += [_cross_links(rare, texts, percent, size, banded=False), rare]
    final = components(links.union(crossing[0]).union(crossing[1]) if some else links.union(crossing[0]))
    release(reps, shared, bands, candidates, texts, links, first, named, mixed, crowded, *crossing)
    member = light.join(classes, (light.set_a == classes.set_a) & (light.set_b == classes.set_b) & (light.n_shingles > 0), "left").select(light.id, light.n_shingles, F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
    out = member.join(final, F.col("class_id") == F.col("node"), "left").select("id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
