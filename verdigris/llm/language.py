"""Language identification by unigrams of pieces, summed over segmentations.

Each language has a probability for every piece of a fixed public vocabulary and for every single
byte. A word's probability is the sum over all its segmentations into pieces, by a forward
algorithm over many words at once; EM sets the probabilities from the same sums. Words of any length
are summed whole: short ones as products, longer ones as logarithms.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.arrow import trim, with_columns
from verdigris.llm.store import least_hashed
from verdigris.llm.words import BASE, BYTE, mix, places, powers, words

#: Bytes of a word, with its space, up to which products neither vanish nor overflow; beyond, sums are of logarithms.
SHORT = 33
#: Each byte's factor in products.
LIFT = 32.0
#: Bytes of words that are summed together, and steps whose pieces are found together.
CELLS, STEPS = 400_000, 4096
#: Letters; what else is ASCII separates words.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
UNKNOWN = "und"


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in UTF-8 become small."""
    out = data.copy()
    out[(data >= ord("A")) & (data <= ord("Z"))] += 32
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    small = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[small] += 32
    return out


class Pieces:
    """Numbers of pieces by a hash of their bytes; a word's start counts as a space before it. The last 256 are the single bytes."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found = {bytes(lower(np.frombuffer(model.id_to_piece(i).replace("▁", " ").encode(), np.uint8))) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in found if len(p) > 1 and b" " not in p[1:])
        self.size, self.longest = len(self.pieces) + 256, max(map(len, self.pieces))
        self.power = powers(BASE, self.longest)
        keys = np.array([self.hash(np.frombuffer(p, np.uint8)) for p in self.pieces], np.uint64)
        self.bits = 20
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for number, key in enumerate(keys.tolist()):
            at = key >> (64 - self.bits)
            while self.values[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, number

    def hash(self, piece: np.ndarray) -> np.uint64:
        return mix(np.array([(BYTE[piece] * self.power[: len(piece)]).sum(dtype=np.uint64)]))[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (self.values[at] >= 0)
            todo, at = todo[more], at[more]
        return out

    def lattice(self, text: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray | None, np.ndarray]]]]:
        """Of a matrix of words: for each end in turn the (start, rows, pieces) that end there; rows None: all.

        Pieces are found for STEPS ends at once, so that a very long word needs little memory.
        """
        n, width = text.shape
        back = powers(pow(BASE, -1, 2**64), STEPS + self.longest)
        power = powers(BASE, STEPS + self.longest)
        for low in range(0, width, STEPS):
            high, base = min(width, low + STEPS), max(0, low + 1 - self.longest)
            part = text[:, base:high].T
            sums = np.concatenate([np.zeros((1, n), np.uint64), np.cumsum(BYTE[part] * power[: len(part), None], axis=0, dtype=np.uint64)])
            ends: list[list] = [[] for _ in range(high - low)]
            for size in range(2, min(self.longest, len(part)) + 1):
                a = max(0, low + 1 - size - base)  # the first start whose end is beyond low
                piece = self.find(mix(((sums[a + size :] - sums[a:-size]) * back[a : len(part) - size + 1, None]).ravel()))
                hits = np.flatnonzero(piece >= 0)
                start, rows, piece = hits // n, hits % n, piece[hits]
                edges = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1], [True]])) if len(hits) else []
                for i, j in itertools.pairwise(edges):
                    k = a + int(start[i])
                    ends[k + size - 1 - (low - base)].append((base + k, rows[i:j], piece[i:j]))
            for end, arcs in enumerate(ends, low + 1):
                yield end, [(end - 1, None, len(self.pieces) + text[:, end - 1].astype(np.int64)), *arcs]


@lru_cache(maxsize=2)
def load(model_path: str) -> Pieces:
    """The vocabulary, once per Python worker."""
    return Pieces(model_path)


def matrices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words, as (places, matrix of bytes with a space before each, sizes with it): short words by
    their length, longer ones of like length with zeros after their end."""
    size = ends - starts + 1
    group = np.where(size <= SHORT, size, SHORT + np.ceil(np.log2(size)).astype(np.int64))
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0, [True]])) if len(order) else []
    for i, j in itertools.pairwise(edges):
        step = max(1, CELLS // int(size[order[i:j]].max()))
        for k in range(i, j, step):
            at = order[k : min(j, k + step)]
            text = np.zeros((len(at), int(size[at].max())), np.uint8)
            text[:, 0] = 0x20
            text[:, 1:][np.arange(1, text.shape[1]) < size[at][:, None]] = data[places(starts[at], ends[at] - starts[at])]
            yield at, text, size[at]


def forward(arcs: Iterable, width: int, chance: Callable[[np.ndarray, np.ndarray | None], np.ndarray], shape: tuple[int, ...], logs: bool) -> np.ndarray:
    """Sums over all segmentations up to each step: products, or logarithms. ``chance``: of pieces in rows."""
    alpha = np.full((width + 1, *shape), -np.inf) if logs else np.zeros((width + 1, *shape))
    alpha[0] = 0 if logs else 1
    for end, found in arcs:
        for start, rows, piece in found:
            if rows is None:
                alpha[end] = alpha[start] + chance(piece, rows) if logs else alpha[start] * chance(piece, rows)
            elif logs:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + chance(piece, rows))
            else:
                alpha[end, rows] += alpha[start, rows] * chance(piece, rows)
    return alpha


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # pieces x languages: logarithm of the probability
    lifted: np.ndarray  # the same: probability times LIFT**bytes

    def score(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(starts), len(self.languages)))
        for at, text, size in matrices(data, starts, ends):
            n, width = text.shape
            logs = width > SHORT
            of = self.logs if logs else self.lifted
            alpha = forward(pieces.lattice(text), width, lambda piece, _, of=of: of[piece], (n, len(self.languages)), logs)
            whole = alpha[size, np.arange(n)]
            out[at] = whole if logs else np.log(whole) - width * np.log(LIFT)
        return out


def lift(pieces: Pieces) -> np.ndarray:
    return LIFT ** np.array([*map(len, pieces.pieces), *[1] * 256], np.float64)


def train(pieces: Pieces, counts: list[tuple[str, bytes, int]], rounds: int = 4, smoothing: float = 0.1) -> Model:
    """EM from counts of words by language. Every piece keeps ``smoothing`` counts more in every language."""
    languages = sorted({lang for lang, _, _ in counts})
    number = {lang: k for k, lang in enumerate(languages)}
    counts = sorted(counts)
    data = np.frombuffer(b"".join(w for _, w, _ in counts), np.uint8)
    ends = np.cumsum(np.array([len(w) for _, w, _ in counts], np.int64))
    starts = ends - np.array([len(w) for _, w, _ in counts], np.int64)
    lang = np.array([number[x] for x, _, _ in counts], np.int64)
    weight = np.array([n for _, _, n in counts], np.float64)
    blocks = [(at, size, text.shape[1], list(pieces.lattice(text))) for at, text, size in matrices(data, starts, ends)]
    up = lift(pieces)
    chance = np.ones((pieces.size, len(languages))) / up[:, None] ** 0.5
    chance /= chance.sum(axis=0)
    for _ in range(rounds):
        seen, lifted, log = np.full(chance.shape, smoothing), chance * up[:, None], np.log(chance)
        for at, size, width, arcs in blocks:
            of, n, logs = lang[at], len(at), width > SHORT
            table = log if logs else lifted
            of_piece = lambda piece, rows, table=table, of=of: table[piece, of if rows is None else of[rows]]
            alpha = forward(arcs, width, of_piece, (n,), logs)
            beta = np.full((width + 1, n), -np.inf) if logs else np.zeros((width + 1, n))
            beta[size, np.arange(n)] = 0 if logs else 1
            whole = alpha[size, np.arange(n)]
            for end, found in reversed(arcs):
                for start, rows, piece in found:
                    r = slice(None) if rows is None else rows
                    p = of_piece(piece, rows)
                    if logs:
                        beta[start, r] = np.logaddexp(beta[start, r], beta[end, r] + p)
                        use = np.exp(alpha[start, r] + p + beta[end, r] - whole[r])
                    else:
                        beta[start, r] += beta[end, r] * p
                        use = alpha[start, r] * p * beta[end, r] / whole[r]
                    np.add.at(seen, (piece, of[r]), weight[at][r] * use)
        chance = seen / seen.sum(axis=0)
    return Model(languages, np.log(chance), chance * up[:, None])


def fit(docs: DataFrame, model_path: str, most_rows: int = 800, most_bytes: int = 64 << 20, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on at most ``most_rows`` rows of each language, those of least hash, of ``most_bytes`` together,
    and on their words of up to ``longest`` bytes: bounds on the words that reach the driver. Scores have
    no such bounds. Rows without an id or a language aren't learned from, rows that repeat count each; without
    any row there is no language and all is UNKNOWN."""
    docs = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text")).filter("_lang IS NOT NULL AND _doc IS NOT NULL")
    labelled = docs.select(F.col("_doc").alias("_id"), "_lang", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("_bytes"))
    chosen = least_hashed(labelled, ["_id", "_lang", "_bytes"], most_rows, "_lang", "_bytes", most_bytes).select("_id").distinct()
    rows = docs.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_lang", "_text")

    def make(batch: pa.RecordBatch) -> list:
        found = words(batch.column("_text"), kinds=KINDS, change=lower)
        spans = [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
        return [pa.array([spans[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)], pa.list_(pa.binary()))]

    split = with_columns(rows, "_text", [T.StructField("_words", T.ArrayType(T.BinaryType()))], make, ["_lang"])
    counts = split.select("_lang", F.explode("_words").alias("_word")).filter(F.octet_length("_word") <= longest).groupBy("_lang", "_word").count().collect()
    found = train(load(model_path), [(r["_lang"], bytes(r["_word"]), r["count"]) for r in counts])
    del counts
    trim()
    return found


def predict(df: DataFrame, model: Model, model_path: str, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_col`` and ``score_col``, the likeliest language of the whole text and its share of the
    likelihood under equal priors. Texts that are null or have no letter, and all texts where the model
    knows no language, are UNKNOWN with score 0. Ties go to the language first by code point. Every row stands for itself: repeated
    rows agree, ids play no part, very long texts and words are summed whole, and an empty table gives no rows. Other columns
    stay; those named like a result are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        known = shared.value
        pieces = load(model_path)
        column = batch.column(text_col)
        found = words(column, kinds=KINDS, change=lower)
        n, k = len(column), len(known.languages)
        plain = np.concatenate([[0], np.cumsum(found.data[found.starts] < 128)])
        letters = np.diff(plain[found.bounds]) > 0
        for i in np.flatnonzero(~letters & (np.diff(found.bounds) > 0)):
            letters[i] = any(c.isalpha() for c in column[i].as_py())
        if not k:
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n))]
        _, first, of = np.unique(found.hashes, return_index=True, return_inverse=True)
        each = known.score(pieces, found.data, found.starts[first], found.ends[first])
        sums = np.concatenate([np.zeros((1, k)), np.cumsum(each[of], axis=0)])
        total = sums[found.bounds[1:]] - sums[found.bounds[:-1]]
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [pa.array([known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], pa.string()), pa.array(np.where(letters, share, 0.0))]

    return with_columns(df, text_col, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], make, keep)
