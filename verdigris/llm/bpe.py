"""Byte-level BPE by a rank file.

Texts are split into pieces all at once, by the class of each character. Distinct pieces are encoded
together: pieces of like length form a padded matrix of token ids, and in each round every row merges
its leftmost pair of least rank. Ranks of pairs come from an open-addressing hash table in numpy. A
round removes one column from every row that merged and drops the others. A long piece is a matrix of
its own, cut into tiles.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdigris.llm.arrow import with_columns
from verdigris.llm.words import BASE, binary, content, places, span_hashes

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
#: Pieces of more bytes are a matrix of their own, of tiles with so many columns.
TILE = 256
#: Pieces that a Python worker remembers, and the longest that it does, in bytes.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
SECOND_BASE = 0xD6E8FEB86659FD93
#: Fixed value: the pattern whose matches are found by character classes; others are left to the regex library.
BY_CLASS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE, LETTER, NUMBER, OTHER = range(4)


class HashTable:
    """32-bit values of 64-bit keys: linear probing over a power of two of slots."""

    def __init__(self, most: int):
        self.bits = max(4, int(most).bit_length() + 1)
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.full(1 << self.bits, NONE, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and aren't there."""
        slot, todo = self.slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == EMPTY
            at, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            left_over = np.ones(len(keys), bool)
            left_over[placed] = False
            todo = todo[left_over[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or NONE."""
        slot = self.slots(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], NONE)
        todo = np.flatnonzero(~hit & (found != EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found != EMPTY)
            todo, slot = todo[more], slot[more]
        return out


class Remembered:
    """Ids of pieces by two 64-bit hashes. When it is full, the pieces seen last stay, half of its size."""

    def __init__(self) -> None:
        self._set(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.now = 0

    def _set(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> None:
        self.first, self.second, self.count, self.ids, self.seen = first, second, count, ids, seen
        self.start = np.cumsum(count) - count
        self.table = HashTable(REMEMBERED)
        self.table.put(first, np.arange(len(first), dtype=np.int32))

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        entry = self.table.get(first).astype(np.int64)
        entry[entry == NONE] = -1
        there = np.flatnonzero(entry >= 0)
        entry[there[self.second[entry[there]] != second[there]]] = -1
        return entry

    def mark(self, entries: np.ndarray) -> None:
        self.now += 1
        self.seen[entries] = self.now

    def add(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, of different ``first`` none of which is there; those that don't fit are left out."""
        if len(self.first) + len(first) > REMEMBERED:
            keep = np.sort(np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2])
            self._set(self.first[keep], self.second[keep], self.count[keep], self.ids[places(self.start[keep], self.count[keep])], self.seen[keep])
        n = min(len(first), REMEMBERED - len(self.first))
        known = len(self.first)
        self.table.put(first[:n], np.arange(known, known + n, dtype=np.int32))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count[:n]) - count[:n]])
        self.ids = np.concatenate([self.ids, ids[: int(count[:n].sum())]])
        self.first, self.second, self.count = np.concatenate([self.first, first[:n]]), np.concatenate([self.second, second[:n]]), np.concatenate([self.count, count[:n]])
        self.seen = np.concatenate([self.seen, np.full(n, self.now)])


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):  # without surrogates
            for found in regex.finditer(pattern, "".join(map(chr, range(low, high)))):
                out[low + found.start() : low + found.end()] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: the place of each character, and its number."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        lead, place = code[wide], at[wide]
        length = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & np.array([0, 0x1F, 0x0F, 0x07])[length]
        for k in (1, 2, 3):
            part = length >= k
            value[part] = value[part] << 6 | (more[place[part] + k] & 0x3F)
        code[wide] = np.minimum(value, 0x10FFFF)
    return at, code


def starts_by_class(code: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Whether a match of BY_CLASS starts at each character; ``row_starts``: the first characters of texts, and the end.

    Runs of a class are matches. The last white space before another character is apart from those
    before it, and a space goes with what follows. An apostrophe that nothing precedes in its match takes certain letters.
    """
    n = len(code)
    kind = _classes()[code]
    first = np.zeros(n + 3, bool)
    first[row_starts] = True
    first[n:] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first[1:n])
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    quote = np.flatnonzero(code == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        after = np.concatenate([code, np.zeros(2, code.dtype)])
        one, two = after[quote + 1], after[quote + 2]
        inside = ~first[quote + 1]
        brief = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~first[quote + 2] & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
        start[quote[brief | long] + 1] = False
        ends = np.concatenate([quote[brief] + 2, quote[long] + 3])
        start[ends[ends < n]] = True
    return start


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.by_class, self.pattern = ranks, pattern == BY_CLASS, regex.compile(pattern)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        left, right, merged = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64).reshape(-1, 3).T
        self.pairs = HashTable(2 * len(left))
        self.pairs.put((left << 32 | right).astype(np.uint64), merged.astype(np.int32))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def remembered(self) -> Remembered:
        """Only encoding has need of it."""
        return Remembered()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, which is its rank, or NONE; ids below 0 are padding."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        real = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        out[real] = self.pairs.get(keys[real].astype(np.uint64))
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them in order; a piece that is a token is that token."""
        counts = np.ones(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        apart = np.flatnonzero(whole < 0)
        for bucket in range(1, TILE.bit_length()):
            rows = apart[(size[apart] > 1 << (bucket - 1)) & (size[apart] <= 1 << bucket)]
            for a in range(0, len(rows), 8192):
                done += self.merge_rows(pieces, rows[a : a + 8192], size, counts)
        for k in apart[size[apart] > TILE].tolist():
            ids = self.merge_tiles(pieces[k])
            counts[k] = len(ids)
            done.append((np.array([k]), ids))
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in done:
            out[places(start[rows], counts[rows])] = ids
        return counts, out

    def merge_rows(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids in order) as the rows of a block of pieces come to their end; sets their counts."""
        width, done = int(size[rows].max()), []
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < size[rows][:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[k] for k in rows.tolist()]), np.uint8)]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[each, at] if rank.shape[1] else np.full(len(rows), NONE)
            stay = best != NONE
            if not stay.all():
                ended = ids[~stay]
                real = ended >= 0
                counts[rows[~stay]] = real.sum(axis=1)
                done.append((rows[~stay], ended[real]))
                rows, ids, rank, at, best = rows[stay], ids[stay], rank[stay], at[stay], best[stay]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            rank = rank[keep[:, 1:]].reshape(len(rows), -1)
            if rank.shape[1]:
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < rank.shape[1])
                    r, c = each[ok], side[ok]
                    rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        return done

    def merge_tiles(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, a matrix whose rows are tiles: a round finds the tile of the
        leftmost least rank by the tiles' minima and looks at no other tile but the one after it."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        while True:
            n = len(ids)
            rows = -(-n // TILE)
            tiles, rank = np.full((rows, TILE), -1, np.int32), np.full(rows * TILE, NONE)
            tiles.ravel()[:n] = ids
            rank[: n - 1] = self.rank(ids[:-1], ids[1:])
            rank = rank.reshape(rows, TILE)
            size = np.minimum(TILE, n - TILE * np.arange(rows))
            least = rank.min(axis=1)
            after = list(range(1, rows + 1))
            before = list(range(-1, rows - 1))
            merges = 0

            def take(r: int, c: int) -> None:
                """Removes an entry; a tile without any is passed over."""
                m = size[r]
                tiles[r, c : m - 1] = tiles[r, c + 1 : m]
                rank[r, c : m - 1] = rank[r, c + 1 : m]
                rank[r, m - 1] = NONE
                size[r] = m - 1
                if m == 1:
                    if after[r] < rows:
                        before[after[r]] = before[r]
                    if before[r] >= 0:
                        after[before[r]] = after[r]

            def renew(r: int, c: int) -> None:
                """The rank of an entry and the one after it."""
                left = int(tiles[r, c])
                right = int(tiles[r, c + 1]) if c + 1 < size[r] else int(tiles[after[r], 0]) if after[r] < rows else -1
                rank[r, c] = self.pairs.get(np.array([left << 32 | right], np.uint64))[0] if right >= 0 else NONE

            while merges < n // 2:  # then the tiles are filled again
                r = int(least.argmin())
                best = least[r]
                if best == NONE:
                    return np.concatenate([tiles[k, : size[k]] for k in range(rows)])
                c = int(rank[r].argmin())
                merges += 1
                tiles[r, c] = best
                next_row = r if c + 1 < size[r] else after[r]
                take(next_row, c + 1 if next_row == r else 0)
                renew(r, c)
                if c:
                    renew(r, c - 1)
                elif before[r] >= 0:
                    renew(before[r], int(size[before[r]]) - 1)
                    least[before[r]] = rank[before[r]].min()
                least[r] = rank[r].min()
                if next_row != r:
                    least[next_row] = rank[next_row].min()
            ids = np.concatenate([tiles[k, : size[k]] for k in range(rows)])

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, in bytes, and the bounds of each text's."""
        at, code = code_points(data)
        rows = np.searchsorted(at, offsets)
        if self.by_class:
            start = np.flatnonzero(starts_by_class(code, rows)) if len(code) else np.zeros(0, np.int64)
            return at[start], np.append(at[start[1:]], len(data))[: len(start)], np.searchsorted(start, rows)
        spans = [[m.span() for m in self.pattern.finditer(data[a:b].tobytes().decode())] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        place = np.append(at, len(data))
        flat = np.array([(r + a, r + b) for r, found in zip(rows[:-1].tolist(), spans, strict=True) for a, b in found], np.int64).reshape(-1, 2)
        return place[flat[:, 0]], place[flat[:, 1]], np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)

    def encode_column(self, column: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty: none."""
        data, offsets = content(column)
        a, b, bounds = self.split(data, offsets)
        known = self.remembered
        first, second = (span_hashes(data, a, b, base) for base in (BASE, SECOND_BASE))
        first[first == EMPTY] = 0
        brief = b - a <= LONGEST_REMEMBERED
        entry = np.where(brief, known.find(first, second), -1)
        missing = np.flatnonzero((entry < 0) & brief)
        if len(missing):
            _, at = np.unique(first[missing], return_index=True)
            new = missing[np.sort(at)]
            new = new[known.table.get(first[new]) == NONE]  # one hash of another piece may be there
            known.mark(entry[entry >= 0])
            known.add(first[new], second[new], *self.encode_pieces(_cut(data, a[new], b[new])))
            entry = np.where(brief, known.find(first, second), -1)
        known.mark(entry[entry >= 0])
        count, start, ids = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), known.ids
        held = entry >= 0
        count[held], start[held] = known.count[entry[held]], known.start[entry[held]]
        apart = np.flatnonzero(~held)
        if len(apart):  # long ones, and what isn't remembered
            pieces = _cut(data, a[apart], b[apart])
            number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            of = np.array([number[p] for p in pieces])
            counts, more = self.encode_pieces(list(number))
            count[apart], start[apart] = counts[of], len(ids) + (np.cumsum(counts) - counts)[of]
            ids = np.concatenate([ids, more])
        ends = np.concatenate([[0], np.cumsum(count)])
        return binary(ids[places(start, count)].astype("<u4").view(np.uint8), 4 * ends[bounds])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def decode_column(self, column: pa.Array) -> pa.Array:
        """The bytes that ids stand for; null and empty: none."""
        data, offsets = content(column)
        ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
        size = self.token_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return binary(self.token_bytes[places(self.token_start[ids], size)], ends[offsets // 4])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_column(pa.array([ids], pa.binary()))[0].as_py()


def _cut(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


@lru_cache(maxsize=2)
def _load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file, once per Python worker. An executor has the file at ``path`` or as shipped by addFile."""
    with open(path if not path.startswith("spark-file:") else SparkFiles.get(path[11:]), "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids_col``: the ids of ``text_col`` as binary, little-endian unsigned 32-bit.

    Null and empty texts have no ids (an empty binary, never null). Other columns stay; one named
    ``ids_col`` is replaced. Every row stands for itself: repeated rows have equal ids, very long texts are encoded whole, and
    an empty table gives no rows. ``ranks_path`` must be readable on every executor ("spark-file:NAME"
    for a file given to SparkContext.addFile).
    """

    def make(batch: pa.RecordBatch) -> list:
        return [_load(ranks_path, pattern).encode_column(batch.column(text_col))]

    return with_columns(df, text_col, [T.StructField(ids_col, T.BinaryType())], make, keep)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``bytes_col``: the bytes that ``ids_col`` stands for; null ids: no bytes. Other columns stay; one of that name is replaced."""

    def make(batch: pa.RecordBatch) -> list:
        return [_load(ranks_path, pattern).decode_column(batch.column(ids_col))]

    return with_columns(df, ids_col, [T.StructField(bytes_col, T.BinaryType())], make, keep)


