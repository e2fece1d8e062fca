"""Repair of conversation structure: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

A forward Viterbi pass over a conversation's turns has four states, what the grammar has seen last: nothing, a system message, a
user's or an assistant's. Each state carries its least (cost, audit string). A turn is kept, given another role or deleted, and each
turn's layer is closed by at most two inserted messages. Turns come sorted, one after another, as a few flags each; a layer is four
costs, the order of its four strings and a byte a state for the way back, so no string is copied and a conversation may be long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.arrow import mapped
from verdigris.llm.store import release, stored

BLANKS = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: States that a message of each state's role may follow.
BEFORE = {SYSTEM: (EMPTY,), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Inserted messages from one state to another.
INSERTS = {(p, p): 0 for p in range(4)} | {(EMPTY, USER): 1, (EMPTY, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}
RENAMED = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


def _steps(initial: str, truncated: bool, deleted: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a turn of that kind: (state before, cost, letters) of all ways there, inserts first."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
    for (p, q), inserts in INSERTS.items():
        out[q].append((p, INSERT * inserts + DELETE, "I" * inserts + "D"))
        if not deleted:
            for after, before in BEFORE.items():
                if q in before and (OF_INITIAL.get(initial) == after or after in RENAMED):
                    letter, cost = ("K", 0) if OF_INITIAL.get(initial) == after else ("R", RENAME)
                    out[after].append((p, INSERT * inserts + cost + TRUNCATED * truncated, "I" * inserts + letter))
    return out


STEPS = {(i, t, d): _steps(i, t, d) for i in ("s", "u", "a", "") for t in (False, True) for d in (False, True)}
ENDS = [(p, INSERT * n, "I" * n) for (p, q), n in INSERTS.items() if q == ASSISTANT or (p, q) == (EMPTY, EMPTY)]
WAYS = sorted({(p, letters) for steps in STEPS.values() for ways in steps for p, _, letters in ways})
CODE = {way: k for k, way in enumerate(WAYS)}


class Repair:
    """The pass over one conversation.

    Strings of one layer hold as many letters other than I as turns and end with one, and equal strings mean equal states: none
    begins another, so their order within a layer decides between all that follow. ``rank`` is that order.
    """

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.back = bytearray()

    def add(self, initial: str, truncated: bool, deleted: bool) -> None:
        cost, rank = self.cost, self.rank
        best = [min(((cost[p] + more, rank[p], letters, p) for p, more, letters in ways if cost[p] is not None), default=None) for ways in STEPS[initial, truncated, deleted]]
        self.cost = [None if b is None else b[0] for b in best]
        order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b is not None)
        self.rank = [0, 0, 0, 0]
        for k, (_, _, q) in enumerate(order):
            self.rank[q] = k
        self.back += bytes(255 if b is None else CODE[b[3], b[2]] for b in best)

    def result(self) -> tuple[int, str]:
        """The least (cost, audit string) that ends the conversation."""
        cost, _, letters, state = min((self.cost[p] + more, self.rank[p], letters, p) for p, more, letters in ENDS if self.cost[p] is not None)
        found = [letters]
        for at in range(len(self.back) - 4, -1, -4):
            state, letters = WAYS[self.back[at + state]]
            found.append(letters)
        return cost, "".join(reversed(found))


def prepared(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, sha): names of our own, so that no column of ``df`` is in the way; null roles and texts are one space."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))


def _order() -> list[Column]:
    """A conversation's order; rows that are equal in all of it are copies."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]


def _turns(rows: DataFrame) -> DataFrame:
    """(id, turn, n, initial, blank, truncated, first), sorted within each conversation: a row for all copies of a turn.

    ``first``: no earlier turn has that role and text, so only the row's further copies are duplicates. Copies are counted before they are shuffled.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    flags = [F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated")]
    counted = rows.select("id", "turn", "role", "sha", *flags).groupBy("id", "turn", "role", "sha", "initial", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    seen = Window.partitionBy("id", "role", "sha").orderBy(F.col("turn").asc_nulls_first())
    return counted.repartition("id").withColumn("first", F.row_number().over(seen) == 1).sortWithinPartitions("id", *_order()).select("id", "turn", "n", "initial", "blank", "truncated", "first")


DECIDED = "id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _decided(turns: DataFrame) -> DataFrame:
    """What is wrong with each conversation and the edits that repair it, from ``_turns``; see ``repair``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key: list | None = None
        repair, gaps, counts, last_turn, last_initial = Repair(), 0, [0, 0, 0, 0], None, None

        def close() -> None:
            if key is not None:
                out.append((key[0], gaps, *counts, *repair.result()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 8
            out.clear()
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for batch in batches:
            for name, turn, n, initial, blank, cut, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or name != key[0]:
                    close()
                    key = [name]
                    repair, gaps, counts, last_turn, last_initial = Repair(), 0, [0, 0, 0, 0], None, None
                if turn is not None and turn != last_turn:
                    gaps += turn - last_turn - 1 if last_turn is not None else 0
                    last_turn = turn
                kind = initial if initial in OF_INITIAL else ""
                for k in range(n):
                    again = not blank and (k > 0 or not first)
                    counts[0] += blank
                    counts[1] += again
                    counts[2] += cut and not blank and not again
                    counts[3] += last_initial is not None and last_initial + initial not in LEGAL
                    last_initial = initial
                    repair.add(kind, cut and not blank and not again, blank or again)
            if len(out) > 5000:
                yield batch_of()
        close()
        yield batch_of()

    return mapped(turns, run, DECIDED)


def _lines(batches: Iterator[pa.RecordBatch], begin: Callable[[str | None], None], line: Callable[[str, str], None]) -> Iterator[None]:
    """Goes through conversations, each its audit string and then its rows, calling ``begin`` with each id and ``line`` with each role and
    text of the repaired form; stops after every batch."""
    audit, at, state, rows = "", 0, EMPTY, 0

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            line(RENAMED[state], "")
            at += 1

    for batch in batches:
        for name, found, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "audit", "role", "text")), strict=True):
            if found is not None:
                audit, at, state = found, 0, EMPTY
                begin(name)
            else:
                if audit[at] == "K":
                    state = OF_INITIAL[role[0]]
                    line(role, text)
                elif audit[at] == "R":
                    state = ASSISTANT if state == USER else USER
                    line(RENAMED[state], text)
                at += 1
            inserted()
        yield


def _with_audits(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of each conversation in order, its audit string before them: all of one in one task, read as a stream and never held together."""
    heads = decided.select("id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(heads)
    return both.repartition("id").sortWithinPartitions("id", F.col("audit").isNull(), *_order()).select("id", "audit", "role", "text")


def _digests(ordered: DataFrame) -> DataFrame:
    """(id, repaired_sha256): SHA-256 of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        digests: list[str] = []
        state: list = [None, None, True]  # id, hash, no line yet

        def close() -> None:
            if state[1] is not None:
                names.append(state[0])
                digests.append(state[1].hexdigest())

        def begin(name: str | None) -> None:
            close()
            state[:] = [name, hashlib.sha256(), True]

        def line(role: str, text: str) -> None:
            state[1].update(("" if state[2] else "\n").encode() + role.encode() + b":" + text.encode())
            state[2] = False

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], names=["id", "repaired_sha256"])
            names.clear()
            digests.clear()
            return out

        for _ in _lines(batches, begin, line):
            yield batch_of()
        close()
        yield batch_of()

    return mapped(ordered, run, "id string, repaired_sha256 string")


def _repaired(ordered: DataFrame) -> DataFrame:
    """(id, place, role, text): the messages of the repaired conversations, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: list = [None, 0]

        def begin(name: str | None) -> None:
            now[:] = [name, 0]

        def line(role: str, text: str) -> None:
            now[1] += 1
            out.append((now[0], now[1], role, text))

        for _ in _lines(batches, begin, line):
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "place", "role", "text"])

    return mapped(ordered, run, "id string, place long, role string, text string")


def decide(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation.

    Turns are taken by number, nulls first, and of one number by role and SHA-256 of the text. A turn's first fault counts: blank, then a
    role and text seen earlier, then a last character other than ``.!?``. Keep (K) costs 0 and needs the role's
    initial, a new role (R) 2, Delete (D) 3, which blank and duplicate turns need, an inserted message (I) 2; truncated turns that stay add 1.
    Of the cheapest audit strings it is the ASCII-least. A null id is a conversation of its own; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType
    found = _decided(_turns(prepared(df, id_col, turn_col, role_col, text_col)))
    return found.select(F.col("id").cast(kind).alias(id_col), *[c.split()[0] for c in DECIDED.split(", ")[1:]])


def repaired(df: DataFrame, decided: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, place, role, text): the repaired conversations, from ``decide`` of the same rows. Inserted messages have empty texts."""
    ordered = _with_audits(prepared(df, id_col, turn_col, role_col, text_col), decided.select(F.col(id_col).cast("string").alias("id"), "audit"))
    return _repaired(ordered).select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "place", "role", "text")


def repair(df: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``decide`` with repaired_sha256, the digest of the repaired lines ``role:text``, joined by line ends.

    ``ids``: a table with all ids that are wanted; those without rows get zeros, an empty audit and the digest of nothing.
    A conversation's digest and least string are made in order, so its turns pass through one task: as a stream that Spark sorts with
    spilling, of which the task holds four bytes a turn and its audit string.
    """
    kind = df.schema[id_col].dataType
    rows = prepared(df, id_col, turn_col, role_col, text_col)
    decided = stored(_decided(_turns(rows)), "conversation-edits")
    digests = _digests(_with_audits(rows, decided.select("id", "audit"))).withColumnRenamed("id", "_id")
    both = decided.join(digests, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    if ids is not None:
        wanted = ids.groupBy(F.col(f"`{id_col}`").cast("string").alias("_id")).agg(F.lit(1).alias("_one"))
        both = wanted.join(both, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("id", F.col("_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = both.select(F.col("id").cast(kind).alias(id_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    out = stored(out, "conversation-repairs")
    release(decided)
    return out


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", of: int = 20) -> DataFrame:
    """``df`` with faults by CRC-32 of ``id:turn`` modulo ``of``: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats
    it and 4 makes its role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % of
    text, role = space(text_col), space(role_col)
    changed = df.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.col(f"`{turn_col}`").alias(turn_col),
        F.when(kind == 4, "user").otherwise(role).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return changed.filter("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")
