import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.llm.util import assert_same
from verdigris.llm import conversations as C
from verdigris.llm.queries import ORACLE_SQL, QUERIES

ROWS = "conv_id long, turn long, role string, text string, id string, audit string, sha string, n long, _times int"
GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """The least (cost, audit, lines) of all edits with at most two inserts between turns."""
    inserts = [[("I", 2, r + ":", r[0]) for r in of] for n in range(3) for of in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(k, cost, audit, roles, lines):
        nonlocal best
        for more in inserts:
            c, a, r, said = cost + 2 * len(more), audit + "I" * len(more), roles + "".join(x[3] for x in more), lines + [x[2] for x in more]
            if not any(GOOD.fullmatch(r + rest) for rest in ("", "a", "ua")):
                continue
            if k == len(rows):
                if GOOD.fullmatch(r) and (best is None or (c, a) < best[:2]):
                    best = c, a, said
                continue
            role, text, gone, cut = rows[k]
            go(k + 1, c + 3, a + "D", r, said)
            if not gone:
                go(k + 1, c + cut, a + "K", r + (role[:1] or "?"), [*said, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(k + 1, c + 2 + cut, a + "R", r + new[0], [*said, f"{new}:{text}"])

    go(0, 0, "", "", [])
    return best


def by_hand(rows):
    """All columns of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = [t for t, *_ in rows if t is not None]
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
        if fault < 3:
            counts[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault < 2, int(fault == 2)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def made(n, seed):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \n", "d?\t", "e.\xa0", None]
    roles = ["user", "assistant", "system", "tool", "", None, "s", "usr"]
    return {k: [(rng.choice([0, 1, 2, 3, 7, None]), rng.choice(roles if k % 3 else roles[:3]), rng.choice(texts if k % 2 else texts[:3])) for _ in range(rng.randint(1, 4))] for k in range(n)}


def test_as_by_hand(spark):
    told = made(150, 5)
    table = spark.createDataFrame([(k if k else None, *r, "x", "y", "z", 4, 5) for k, rows in told.items() for r in rows], ROWS)
    got = {r.conv_id or 0: tuple(r)[1:] for r in C.repair(table).collect()}
    want = {k: by_hand(rows) for k, rows in told.items()}
    assert got == {k: v[:-1] for k, v in want.items()}
    said = {}
    for r in sorted(C.repaired(table, C.decide(table)).collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id or 0, []).append(f"{r.role}:{r.text}")
    assert said == {k: v[-1] for k, v in want.items() if v[-1]}


def test_pass_without_spark():
    """Longer conversations: the carried order of strings against strings themselves."""
    rng = random.Random(3)
    for _ in range(300):
        kinds = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.4, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        states = {C.EMPTY: (0, "")}
        repair = C.Repair()
        for initial, cut, gone in kinds:
            repair.add(initial, cut, gone)
            after = {}
            for q, ways in enumerate(C.STEPS[initial, cut, gone]):
                if found := [(states[p][0] + c, states[p][1] + letters) for p, c, letters in ways if p in states]:
                    after[q] = min(found)
            states = after
        assert repair.result() == min((states[p][0] + c, states[p][1] + letters) for p, c, letters in C.ENDS if p in states)


def test_damage(spark):
    rows = [(k, t, "assistant", f"Text {k}. Is it? {t}!") for k in range(30) for t in range(4)] + [(None, None, None, None), (5, None, "user", "x.")]
    table = spark.createDataFrame([(*r, "x", "y", "z", 4, 5) for r in rows], ROWS)
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in C.damaged(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) != len(rows)


def test_conversations_without_rows(spark):
    ids = spark.createDataFrame([(1,), (2,), (None,), (2,)], "conv_id long")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r) for r in C.repair(none, ids=ids).collect()} == {(1, *nothing), (2, *nothing), (None, *nothing)}
    assert C.repair(none).count() == 0 == C.repaired(none, C.decide(none)).count()


def test_long_and_repeated(spark):
    """One conversation of many turns and one of one turn very often; a very long text."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(20_000)] + [(2, 0, "user", "same.")] * 3000 + [(3, 0, "user", "long " * 400_000), (3, 1, "assistant", "short.")]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].audit == "K" * 20_000 and got[1].cost == 0
    assert (got[2].duplicate, got[2].cost, got[2].audit) == (2999, 2999 * 3 + 2, "K" + "D" * 2999 + "I")
    assert (got[3].truncated, got[3].cost, got[3].audit) == (1, 1, "KK")
    assert got[3].repaired_sha256 == hashlib.sha256(("user:" + "long " * 400_000 + "\nassistant:short.").encode()).hexdigest()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_as_sql(spark, sf):
    assert_same(QUERIES["op13_conversations"](spark, sf), ORACLE_SQL["op13_conversations"], sf)
