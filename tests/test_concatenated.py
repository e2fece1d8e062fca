import json
import random

import pandas as pd
import pytest

from verdigris.sources import concatenated as C

STRINGS = ["", "a", "}{", '"', "\\", "漢{字}", "é" * 9, '{"k": 1}', "line\nend", "} {", "x" * 120]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(STRINGS)
    if kind == 2:
        return rng.choice([0, -12.5, 1e30, True, None, 123456789])
    if kind == 3:
        return rng.randint(0, 9999)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc{}"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


JUNK = [" ", "\n", ",", "junk {", "{{", "} }", '"', 'open "string', "{\"a\": tru", "[1, 2]", "", "{\"a\" 1}", "\\", "漢"]


def made(seed, n=150, junk=0.3):
    rng = random.Random(seed)
    parts = []
    for k in range(n):
        if rng.random() < junk:
            parts.append(rng.choice(JUNK))
        parts.append(json.dumps({"k": k, "v": value(rng), "s": rng.choice(STRINGS)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1])))
    return "".join(parts) + rng.choice(["", "\n", " tail", "{", '{"a": {"b": 1}', '{"k": 5'])


def in_splits(text, size):
    """What Spark's tasks make of a file in splits of ``size`` bytes: a line that begins at the first byte of a split belongs to the one before."""
    data = text.encode()
    pieces, at, rows = data.split(b"}"), 0, []
    pieces = pieces[:-1] if not pieces[-1] else pieces
    for piece in pieces:
        block = 0 if at == 0 else (at - 1) // size * size
        rows.append((piece.decode(), "f", block, min(size, len(data) - block), len(data), len(piece)))
        at += len(piece) + 1
    return pd.DataFrame(rows, columns=["value", "file", "block", "length", "size", "n"])


def read(text, size):
    """Objects of the splits and across them; None if the file goes to one task."""
    rows = pd.concat([*C._read(iter([in_splits(text, size)])), pd.DataFrame(columns=C._names(C.READ))])
    edges = rows[rows.kind != "object"]
    after = {r.block: r for r in edges.itertuples()}
    pairs = []
    for r in edges[edges.block + edges.length < edges["size"]].itertuples():
        to = after.get(r.block + r.length)
        pairs.append((r.kind, r.file, r.block, r.length, r.text, r.marks, *((to.text, to.marks, to.seq) if to is not None else (None, None, None))))
    met = pd.concat(list(C._met(iter([pd.DataFrame(pairs, columns=["kind", "file", "block", "length", "text", "marks", "next_text", "next_marks", "next_whole"])]))))
    open_end = edges["bytes"].sum() > len(text.encode()) and (edges[edges.block + edges.length >= edges["size"]].closed.any() or (met.kind == "closed").any())
    if (met.kind == "lost").any() or open_end:
        return None
    begin = {r.block: r.seq for r in met[met.kind == "from"].itertuples()}
    found = [r.text for r in rows[rows.kind == "object"].itertuples() if r.seq >= begin.get(r.block, 0)]
    return found + list(met[met.kind == "object"].text)


@pytest.mark.parametrize("junk", [0.0, 0.3])
@pytest.mark.parametrize(("size", "edge"), [(40, 1 << 20), (300, 1 << 20), (2000, 1 << 20), (400, 60), (10**7, 1 << 20)])
def test_splits_agree_or_say_so(monkeypatch, junk, size, edge):
    monkeypatch.setattr(C, "EDGE", edge)
    apart = 0
    for seed in range(40):
        text = made(seed, 60, junk)
        got = read(text, size)
        if got is not None:
            assert sorted(got) == sorted(C.objects(text))
            apart += 1
    assert apart >= (10 if size >= 2000 or (size == 300 and not junk) else 0)


@pytest.mark.parametrize(("size", "edge"), [(1500, 1 << 20), (1500, 60)])
def test_as_the_sequential_reader(spark, tmp_path, monkeypatch, size, edge):
    """Files in splits; edges that are too short for an object send a file to one task."""
    monkeypatch.setattr(C, "EDGE", edge)
    texts = [made(seed, 60) for seed in range(2)] + ["", "no object", "{}", '{"k": 1', '{"k": 7}']
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.txt").write_text(text)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = C.concatenated_json(spark, str(tmp_path), "k long, s string").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = [v for text in texts for v in map(json.loads, C.objects(text))]
    key = lambda k, s: (k is None, k if isinstance(k, int) else 0, s or "")
    assert sorted(key(r.k, r.s) for r in got) == sorted(key(v.get("k"), v.get("s")) for v in want)


def test_object_longer_than_splits(spark, tmp_path):
    """One object over many splits is found by one task."""
    text = '{"k": 1} ' + json.dumps({"k": 2, "s": "y" * 5000}) + ' {"k": 3}'
    (tmp_path / "f").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert sorted(r.k for r in C.concatenated_json(spark, str(tmp_path), "k long").collect()) == [1, 2, 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_clean_files_stay_in_many_tasks(spark, tmp_path, monkeypatch):
    """Objects back to back need no task for a whole file."""
    monkeypatch.setattr(C, "objects", lambda text: (_ for _ in ()).throw(AssertionError("read by one task")))
    (tmp_path / "f").write_text("".join(json.dumps({"k": k, "s": "{}"[k % 2] * (k % 60), "in": {"deep": [{"k": -1}]}}) for k in range(1500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "12000")
        rows = C.concatenated_json(spark, str(tmp_path), "k long")
        assert sorted(r.k for r in rows.collect()) == list(range(1500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
