"""Substring dedup: words in passages that start earlier in the corpus are removed.

Suffix automata of reference shards decide. Automata of the whole corpus would not fit an executor, so
the reference is cut into shards by content, and a document visits only shards that can match it:
every window has an anchor, its least word run by hash, equal windows have equal anchors, and
only windows whose anchor occurs twice are candidates. The distinct candidates of an anchor are a shard's
reference; its automaton goes to the tasks that hold the documents' pieces for it, which are streamed through for
their matching statistics. Matches on one diagonal make maximal spans, and a span is removed when its
words are those of the place that the automaton names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.arrow import mapped, slices, with_columns
from verdigris.llm.automaton import SuffixAutomaton
from verdigris.llm.store import release, small, stored
from verdigris.llm.words import BASE, Words, binary, mix, places, powers, words

#: Words of an anchor, and bytes of a word's hash, which is what an automaton sees of it. With 64 bits a match of other words
#: is not to be expected in any corpus: of 10**12 pairs of windows that differ in one word, one in 10**7 corpora would have it.
ANCHOR, SYMBOL = 6, 8
#: Anchors of more occurrences are divided by a second run of each window; shards of more distinct pieces are divided by
#: their windows, into shards of about so many distinct ones; and a shard is streamed through in parts of about so many pieces.
HOT = 2000


def _runs(found: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its row, first word and the place and hash of its anchor; then the hashes of all runs by first word."""
    hashes, first, _ = found.windows(ANCHOR)
    by_word = np.zeros(len(found.hashes), np.uint64)
    by_word[first] = hashes
    count = np.maximum(np.diff(found.bounds) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) + np.repeat(found.bounds[:-1] - (np.cumsum(count) - count), count)
    place = _least(by_word, window - ANCHOR + 1)[start]
    return row, start, place, by_word[place], by_word


def _least(values: np.ndarray, n: int, greatest: bool = False) -> np.ndarray:
    """For each place that has n values from it on, the first place of the least (greatest) of them, by doubling; at later places it means nothing."""
    place = np.arange(len(values))
    have = 1
    while have < n:
        step = min(have, n - have)
        first, second = place[:-step], place[step:]
        better = values[second] > values[first] if greatest else values[second] < values[first]
        place = np.concatenate([np.where(better, second, first), place[len(place) - step :]])
        have += step
    return place


def _anchors(df: DataFrame, window: int) -> DataFrame:
    """(anchor, id, place): the anchors of every text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, ids = words(part.column("text")), part.column("id").to_numpy()
                row, _, place, least, _ = _runs(found, window)
                new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
                row, place, least = row[new], place[new], least[new]
                yield pa.RecordBatch.from_arrays([pa.array(least.astype(np.int64)), pa.array(ids[row]), pa.array((place - found.bounds[row]).astype(np.int32))], names=["anchor", "id", "place"])

    return mapped(df, run, "anchor long, id long, place int")


def _pieces(df: DataFrame, window: int) -> DataFrame:
    """(key, piece, id, start, body) from texts with their repeated anchors (hits: place * 2 + hot).

    A piece is a longest run of windows of one anchor: its words as 64-bit hashes, so that each
    of its windows is a candidate and no other piece has it. A hot anchor's windows are divided by their greatest
    word run too; equal windows have that in common as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, ids = words(part.column("text")), part.column("id").to_numpy()
                row, start, place, least, by_word = _runs(found, window)
                hits = part.column("hits")
                flat = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(hits.offsets.to_numpy()) if len(hits) else np.zeros(0, np.int64)
                at = np.repeat(found.bounds[:-1], sizes) + flat // 2
                inside = flat // 2 < np.repeat(np.diff(found.bounds), sizes)
                state = np.zeros(len(found.hashes) + 1, np.int8)
                state[at[inside]] = 1
                state[at[inside & (flat % 2 == 1)]] = 2
                good = state[place] > 0
                row, start, place, least = row[good], start[good], place[good], least[good]
                second = np.zeros(len(start), np.int64)
                hot = np.flatnonzero(state[place] == 2)
                if len(hot):
                    where = _least(by_word, window - ANCHOR + 1, greatest=True)[start[hot]]
                    second[hot] = where + 1
                    least[hot] = mix(least[hot] + mix(by_word[where]))
                new = np.ones(len(start), bool)
                new[1:] = (place[1:] != place[:-1]) | (second[1:] != second[:-1]) | (start[1:] != start[:-1] + 1)
                begin = np.flatnonzero(new)
                last = np.concatenate([begin[1:], [len(start)]])[: len(begin)] - 1
                # a piece's name is a hash of its words' hashes, its body all of them
                size = start[last] + window - start[begin]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * powers(BASE, len(found.hashes)), dtype=np.uint64)])
                back = powers(pow(BASE, -1, 2**64), len(found.hashes) + 1)
                names = mix((sums[start[begin] + size] - sums[start[begin]]) * back[start[begin]] + size.astype(np.uint64)).astype(np.int64)
                bodies = binary(found.hashes[places(start[begin], size)].view(np.uint8), SYMBOL * np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([pa.array(least[begin].astype(np.int64)), pa.array(names), pa.array(ids[row[begin]]), pa.array((start[begin] - found.bounds[row[begin]]).astype(np.int32)), bodies], names=["key", "piece", "id", "start", "body"])

    return mapped(df, run, "key long, piece long, id long, start int, body binary")


def _windows(reference: DataFrame, window: int) -> DataFrame:
    """(key, piece, id, start, body) with every window of a piece as a piece of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                keys, names, ids, starts, bodies = [], [], [], [], []
                for key, doc, start, body in zip(*(part.column(c).to_pylist() for c in ("key", "id", "start", "body")), strict=True):
                    for k in range(len(body) // SYMBOL - window + 1):
                        words_of = body[SYMBOL * k : SYMBOL * (k + window)]
                        keys.append(key)
                        names.append(xxhash.xxh3_64_intdigest(words_of))
                        ids.append(doc)
                        starts.append(start + k)
                        bodies.append(words_of)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(names, np.uint64).astype(np.int64)), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(bodies, pa.binary())], names=["key", "piece", "id", "start", "body"])

    return mapped(reference.select("key", "id", "start", "body"), run, "key long, piece long, id long, start int, body binary")


def _shards(reference: DataFrame, window: int) -> DataFrame:
    """(key, part, salt, streamed, piece, copies, id, start, body): the rows of all shards, named by key and part; copies: 0 none, 2 over HOT.

    Rows that aren't streamed are a shard's reference, distinct pieces where they occur first; they are streamed through the automaton
    too. A key of over HOT distinct pieces is divided by windows: its distinct windows are dealt into
    parts of about HOT, equal ones into the same, so every part has a reference of its own, and the other occurrences of these windows are
    streamed, dealt over salts each of which gets that reference.
    """
    flat = reference.select("key", "piece", "n", "first.id", "first.start", "body")
    zero, copies = F.lit(0).cast("long"), F.when(F.col("n") > HOT, 2).when(F.col("n") > 1, 1).otherwise(0).alias("copies")
    crowded = small(stored(reference.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key"), "sub-crowded"))
    calm = flat.join(crowded, "key", "left_anti").select("key", zero.alias("part"), zero.alias("salt"), F.lit(False).alias("streamed"), "piece", copies, "id", "start", "body")
    # copies of whole pieces have their answer from the undivided piece
    whole = flat.join(crowded, "key", "left_semi").filter("n > 1").select("key", F.xxhash64("piece").alias("part"), zero.alias("salt"), F.lit(False).alias("streamed"), "piece", copies, "id", "start", "body")
    each = stored(_windows(flat.join(crowded, "key", "left_semi"), window), "sub-windows")
    firsts = stored(each.groupBy("key", "piece").agg(F.min(F.struct("id", "start", "body")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "sub-firsts")
    parts = firsts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("long").alias("parts"))
    dealt = firsts.join(parts, "key").select("key", "piece", "f", "n", F.pmod("piece", F.col("parts")).alias("part"))
    salts = dealt.groupBy("key", "part").agg(F.ceil(F.sum("n") / HOT).cast("long").alias("salts"))
    dealt = stored(dealt.join(salts, ["key", "part"]), "sub-dealt")
    windows = dealt.select("key", "part", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), F.lit(False).alias("streamed"), "piece", F.lit(0).alias("copies"), "f.id", "f.start", "f.body")
    names = small(dealt.select("key", "piece", "part", "salts", "f.id", "f.start").toDF("key", "piece", "part", "salts", "f_id", "f_start"))
    others = each.join(names, ["key", "piece"]).filter((F.col("id") != F.col("f_id")) | (F.col("start") != F.col("f_start")))
    others = others.select("key", "part", F.pmod(F.xxhash64("id", "start"), F.col("salts")).alias("salt"), F.lit(True).alias("streamed"), "piece", F.lit(0).alias("copies"), "id", "start", "body")
    return calm.unionByName(whole).unionByName(windows).unionByName(others)


def _decided(shards: DataFrame, window: int) -> DataFrame:
    """What the automata say, from the rows of ``_shards``, those of a shard and salt together, its reference first and in corpus order.

    (key, piece, id, begin, end, first_id, first_begin): with an id, words begin to end of that text are at the earlier place
    too; without one, all words of the piece, which has copies (begin 2: over HOT of them), are first at that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        automaton, begins, starts = SuffixAutomaton(), [], []
        reference: list[tuple[int, int, int, int, list[int]]] = []
        key = None

        def place(symbol: int) -> tuple[int, int]:
            """Document and word of a symbol of the reference."""
            row = bisect_right(begins, symbol) - 1
            doc, start = starts[row]
            return doc, start + symbol - begins[row]

        def answer(doc: int, start: int, found: list[int]) -> None:
            """Runs of windows that are in the reference at an earlier place, on one diagonal. It is in corpus order, so the first place in the automaton is the earliest."""
            open_run: list | None = None
            for k, end in enumerate(found):
                first_doc, first = place(end - window + 1) if end >= 0 else (doc, start + k)
                if (first_doc, first) >= (doc, start + k):
                    open_run = None
                elif open_run is not None and open_run[5] == first_doc and open_run[6] - open_run[3] == first - start - k:
                    open_run[4] = start + k + window
                else:
                    open_run = [None, None, doc, start + k, start + k + window, first_doc, first]
                    out.append(open_run)

        def build() -> None:
            """The automaton of a shard's reference, which is then streamed through it."""
            for _, _, doc, start, body in reference:
                begins.append(automaton.added)
                starts.append((doc, start))
                automaton.add(body)
            for piece, copies, doc, start, body in reference:
                answer(doc, start, automaton.matches(body, window))
                if copies:
                    first_doc, first = place(automaton.whole(body) - len(body) + 1)
                    out.append([key[0], piece, None, copies, len(body), first_doc, first])
            reference.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "piece", "id", "begin", "end", "first_id", "first_begin"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part", "salt", "streamed", "piece", "copies", "id", "start", "body")]
            for *name, streamed, piece, copies, doc, start, body in zip(*columns, strict=True):
                if name != key:
                    build()
                    automaton, begins, starts, key = SuffixAutomaton(), [], [], name
                symbols = np.frombuffer(body, np.uint64).tolist()
                if not streamed:
                    reference.append((piece, copies, doc, start, symbols))
                    continue
                build()
                answer(doc, start, automaton.matches(symbols, window))
            if len(out) > 50_000:
                yield batch_of()
        build()
        yield batch_of()

    return mapped(shards.select("key", "part", "salt", "streamed", "piece", "copies", "id", "start", "body"), run, "key long, piece long, id long, begin int, end int, first_id long, first_begin int")


SPANS = "id long, begin int, end int, first_id long, first_begin int"


def _spans(ranges: DataFrame) -> DataFrame:
    """Maximal spans of each text from ranges (id, begin, end, first_id, first_begin): those on one diagonal that touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            begin, end, first_id, first_begin = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            shift = first_begin.astype(np.int64) - begin
            order = np.lexsort((begin, shift, first_id, rows))
            rows, begin, end, first_id, shift = (x[order] for x in (rows, begin.astype(np.int64), end.astype(np.int64), first_id, shift))
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (first_id[1:] != first_id[:-1]) | (shift[1:] != shift[:-1])
            # the furthest end so far on a diagonal: diagonals are moved apart
            apart = np.cumsum(new) << 32
            furthest = np.maximum.accumulate(end + apart) - apart
            new[1:] |= begin[1:] > furthest[:-1]
            at = np.flatnonzero(new)
            ends = furthest[np.concatenate([at[1:], [len(rows)]]).astype(np.int64)[: len(at)] - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), pa.array(begin[at].astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array(first_id[at]), pa.array((begin + shift)[at].astype(np.int32))], names=["id", "begin", "end", "first_id", "first_begin"])

    return mapped(ranges.groupBy("id").agg(F.collect_list(F.struct("begin", "end", "first_id", "first_begin")).alias("found")), run, SPANS)


def _digest(words_of: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words_of)).digest()


def _proofs(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(first_id, first_begin, size, proof): digests of the words at every place that spans name, each place once."""
    wanted = spans.groupBy("first_id", "first_begin", (F.col("end") - F.col("begin")).alias("size")).agg(F.count(F.lit(1)).alias("_n"))
    by_text = stored(wanted.groupBy("first_id").agg(F.collect_list(F.struct("first_begin", "size")).alias("wanted")), "sub-wanted")
    ids = small(by_text.select(F.col("first_id").alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text, wanted_of in zip(*(part.column(c).to_pylist() for c in ("first_id", "text", "wanted")), strict=True):
                    split = text.encode().split()
                    rows += [(doc, w["first_begin"], w["size"], _digest(split[w["first_begin"] : w["first_begin"] + w["size"]])) for w in wanted_of]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["first_id", "first_begin", "size", "proof"])

    held = texts.join(ids, "id", "left_semi").join(by_text, F.col("id") == F.col("first_id")).select("first_id", "text", "wanted")
    return mapped(held, run, "first_id long, first_begin int, size int, proof binary").distinct()


def _kept(df: DataFrame, text_col: str, spans: bool) -> DataFrame:
    """Adds n_words, n_removed and kept, the other words joined by one space. A span is removed if its words have the digest of its earlier place's."""

    def make(batch: pa.RecordBatch) -> list:
        count, removed, kept = [], [], []
        found = batch.column("_spans").to_pylist() if spans else [None] * batch.num_rows
        for text, span in zip(batch.column(text_col).to_pylist(), found, strict=True):
            split = (text or "").encode().split()  # at the same six characters
            proved = sorted((r["begin"], r["end"]) for r in span or () if r["end"] <= len(split) and _digest(split[r["begin"] : r["end"]]) == r["proof"])
            left, at = [], 0
            for begin, end in proved:
                if begin > at:
                    left += split[at:begin]
                at = max(at, end)
            left = left + split[at:] if proved else split
            count.append(len(split))
            removed.append(len(split) - len(left))
            kept.append(b" ".join(left).decode())
        return [pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    stay = [c for c in df.columns if c != "_spans"]
    return with_columns(df, text_col, fields, make, stay, also=("_spans",) if spans else ())


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Adds n_words, n_removed and kept: the words that no window of ``window`` words covers whose word
    sequence also starts earlier (in a smaller id, or in the same text before), joined by one space.

    Null texts have no words. Rows with a null id neither lose words nor take any. Rows that repeat an
    id and text start at the same place, so neither is earlier; of other texts with one id, each loses only spans whose
    words it has. Other columns stay; those named like a result are replaced.
    """
    numbered = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    anchors = stored(_anchors(numbered, window), "sub-anchors")
    repeated = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "sub-repeated")
    hits = anchors.join(small(repeated), "anchor").groupBy("id").agg(F.collect_list(F.col("place") * 2 + F.col("hot").cast("int")).alias("hits"))
    hits = stored(hits, "sub-hits")
    release(anchors, repeated)
    ids = small(hits.select("id"))
    pieces = stored(_pieces(numbered.join(ids, "id", "left_semi").join(hits, "id").select("id", "text", "hits"), window), "sub-pieces")
    # equal pieces are one; what the automaton says of it holds for all
    reference = stored(pieces.groupBy("key", "piece").agg(F.min(F.struct("id", "start")).alias("first"), F.min("body").alias("body"), F.count(F.lit(1)).alias("n")), "sub-reference")
    order = ["key", "part", "salt"]
    decided = stored(_decided(_shards(reference, window).repartition(*order).sortWithinPartitions(*order, "streamed", "id", "start"), window), "sub-decided")
    answers = decided.filter("id IS NULL").select("key", "piece", "first_id", "first_begin", (F.col("begin") == 2).alias("often"))
    copies = pieces.select("key", "piece", "id", F.col("start").alias("begin"), (F.col("start") + F.octet_length("body") / SYMBOL).cast("int").alias("end"))
    # pieces that very many texts share are joined where they are, if a count allows
    often = answers.filter("often")
    hot = copies.join(small(often), ["key", "piece"])
    rest = copies.join(answers.filter("NOT often"), ["key", "piece"])
    columns = ["id", "begin", "end", "first_id", "first_begin"]
    later = hot.unionByName(rest).filter((F.col("first_id") < F.col("id")) | ((F.col("first_id") == F.col("id")) & (F.col("first_begin") < F.col("begin")))).select(columns)
    spans = stored(_spans(decided.filter("id IS NOT NULL").select(columns).union(later)), "sub-spans")
    release(pieces, reference, decided, hits)
    proofs = stored(_proofs(numbered, spans), "sub-proofs")
    proved = spans.withColumn("size", F.col("end") - F.col("begin")).join(small(proofs), ["first_id", "first_begin", "size"])
    proved = stored(proved.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("begin", "end", "proof")).alias("_spans")), "sub-proved")
    release(spans, proofs)
    touched = small(proved.select("_id"))
    clean = [c for c in df.columns if c not in ("n_words", "n_removed", "kept")]
    own = {c: f"own_{k}" for k, c in enumerate(clean)}  # no name of a column is in the way
    base = df.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()])
    key = F.col(own[id_col]).cast("long")
    whole = _kept(base.join(touched, key == F.col("_id"), "left_anti"), own[text_col], False)
    cut = base.join(touched, key == F.col("_id"), "left_semi").join(proved, key == F.col("_id"))
    both = whole.union(_kept(cut.select(*own.values(), "_spans"), own[text_col], True))
    return both.select(*[F.col(name).alias(c) for c, name in own.items()], "n_words", "n_removed", "kept")
