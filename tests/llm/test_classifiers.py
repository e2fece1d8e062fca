import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from verdigris.llm import language, quality, queries

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_features_as_brute_force():
    texts = ["Good words, good **words** ok", None, "", "so so so", "é É a"]
    bounds, place, value = quality.features(pa.array(texts))
    assert np.diff(bounds).tolist()[1:3] == [0, 0]
    assert all(abs((value[a:b] ** 2).sum() - 1) < 1e-5 for a, b in itertools.pairwise(bounds) if b > a)
    assert np.diff(bounds)[3] == 2  # one word, one repeated pair


def test_ftrl_as_brute_force():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 5, replace=False)).astype(np.int32), np.full(5, 0.4, np.float32)) for _ in range(60)]
    rows = [(p, v, int((p < 12).sum() > 1)) for p, v in rows]
    got = quality.train(rows, passes=2)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for p, v, y in rows:
            x = dict(zip(p.tolist(), v.tolist(), strict=True)) | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x))) - y
            for i in x:
                d = g * x[i]
                z[i] = z.get(i, 0) + d - ((n.get(i, 0) + d * d) ** 0.5 - n.get(i, 0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0) + d * d
    assert all(abs(got[i] - weight(i)) < 1e-5 for i in z)


def test_quality_held_out_accuracy(spark):
    rows = queries.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    apart = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    good = [r.score for r in apart if r.quality]
    bad = [r.score for r in apart if not r.quality]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(g >= 0.3 for g in good) / len(good) > 0.95


def plain_vector(text):
    """Counts of words and of word pairs, a word and itself being one pair, by plain loops; square roots, of length 1."""
    words = re.findall(r"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode().lower().decode("latin-1"))
    counts = {}
    for w in [("word", w) for w in words] + [("again",) if a == b else ("pair", a, b) for a, b in itertools.pairwise(words)]:
        counts[w] = counts.get(w, 0) + 1
    length = sum(counts.values()) ** 0.5
    return {w: n**0.5 / length for w, n in counts.items()}


def test_quality_scores_by_brute_force(spark):
    """Every score again from texts and labels, words unhashed: hashed places that two words share make small differences."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(w):
        if abs(z.get(w, 0)) <= l1:
            return 0.0
        return -(z[w] - (l1 if z[w] > 0 else -l1)) / ((beta + n[w] ** 0.5) / alpha + l2)

    def chance(x):
        return 1 / (1 + np.exp(-sum(weight(w) * v for w, v in x.items())))

    learnt = [(plain_vector(docs[r.doc_id]) | {"bias": 1.0}, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs]
    for _ in range(3):
        for x, y in learnt:
            g = chance(x) - y
            held = {w: weight(w) for w in x}
            for w, v in x.items():
                d = g * v
                z[w] = z.get(w, 0) + d - ((n.get(w, 0) + d * d) ** 0.5 - n.get(w, 0) ** 0.5) / alpha * held[w]
                n[w] = n.get(w, 0) + d * d
    rows = queries.op3_quality(spark, SF).collect()
    want = {i: chance(plain_vector(t) | {"bias": 1.0}) for i, t in docs.items()}
    gaps = np.array([abs(r.score - want[r.doc_id]) for r in rows])
    print(f"largest {gaps.max():.4f}, mean {gaps.mean():.5f}, other side of the threshold {sum((want[r.doc_id] >= 0.3) != r.predicted for r in rows)}")
    assert len(rows) == len(docs) and gaps.max() < 0.1 and gaps.mean() < 0.005
    assert sum((want[r.doc_id] >= 0.3) != r.predicted for r in rows) <= 0.005 * len(rows)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "a b " * 30000, None), (2, "a b", "t"), (2, "a b", "t")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    w = quality.fit(df, labels)
    out = quality.score(df, w)
    assert out.count() == 5 and out.filter("score is null").count() == 0 and out.columns == ["doc_id", "text", "score"]
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


def segmentations(pieces, word):
    known = {p: i for i, p in enumerate(pieces.pieces)}
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        number = len(known) + word[0] if k == 1 else known.get(word[:k])
        if number is not None:
            for rest in segmentations(pieces, word[k:]):
                yield (number, *rest)


def test_forward_as_all_segmentations():
    pieces = language.load(VOCABULARY)
    counts = [("x", "hello".encode(), 3), ("x", "été".encode(), 1), ("y", "haus".encode(), 2), ("y", "hell".encode(), 4)]
    model = language.train(pieces, counts)
    chance = model.lifted / language.lift(pieces)[:, None]
    assert np.allclose(chance.sum(axis=0), 1)
    for word in ("hello", "haus", "été", "q", "zz"):
        raw = np.frombuffer(word.encode(), np.uint8)
        got = model.score(pieces, raw, np.array([0]), np.array([len(raw)]))[0]
        want = sum(np.prod(chance[list(s)], axis=0) for s in segmentations(pieces, b" " + word.encode()))
        assert np.allclose(got, np.log(want))


def log_forward(pieces, chance, word):
    """Sums over segmentations of one word by plain recursion over its ends."""
    known = {p: i for i, p in enumerate(pieces.pieces)}
    raw, out = b" " + word, [np.zeros(chance.shape[1])]
    for end in range(1, len(raw) + 1):
        terms = [out[end - 1] + np.log(chance[len(known) + raw[end - 1]])]
        terms += [out[a] + np.log(chance[known[raw[a:end]]]) for a in range(end - 2, -1, -1) if raw[a:end] in known]
        out.append(np.logaddexp.reduce(terms))
    return out[-1]


def test_words_of_any_length_are_summed_whole(monkeypatch):
    pieces = language.load(VOCABULARY)
    assert pieces.longest > 16
    long = max(pieces.pieces, key=len).decode()
    words = ["internationalisierungsbemühungen" * 2, "a" * 3000, "漢字かな交じり文" * 20, long + "x", long * 3, "ab", "the"]
    model = language.train(pieces, [("x", w.encode()[:1000], 2) for w in words[:5]] + [("y", b"the", 9), ("y", b"ab" * 40, 1)])
    chance = np.exp(model.logs)
    assert np.allclose(chance.sum(axis=0), 1)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    want = [log_forward(pieces, chance, w) for w in raw]
    for steps in (4096, 7):
        monkeypatch.setattr(language, "STEPS", steps)
        got = model.score(pieces, np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        assert np.allclose(got, want, rtol=1e-9)


def test_long_words_train_as_short_ones(monkeypatch):
    pieces = language.load(VOCABULARY)
    counts = [("x", w.encode(), n) for w, n in {"hello": 3, "été": 1, "other": 2}.items()] + [("y", b"haus", 2)]
    one = language.train(pieces, counts)
    monkeypatch.setattr(language, "SHORT", 0)
    assert np.allclose(one.logs, language.train(pieces, counts).logs)


def test_language_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    model = language.fit(docs.filter(~quality.held_out(F.col("doc_id"), 4, 2)), VOCABULARY)
    got = {r.doc_id: r for r in queries.op7_language(spark, SF).collect()}
    pieces, chance, held = language.load(VOCABULARY), np.exp(model.logs), {}
    apart = re.compile(rb"[A-Za-z\x80-\xff]+")
    for d in docs.filter("doc_id % 5 = 0").collect():
        total = np.zeros(len(model.languages))
        for word in apart.findall(bytes(language.lower(np.frombuffer((d.text or "").encode(), np.uint8)))):
            if word not in held:
                held[word] = log_forward(pieces, chance, word)
            total += held[word]
        r = got[d.doc_id]
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == model.languages[total.argmax()] and abs(r.score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_language_learns_rare_languages(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(400)] + [(1000, "das Haus ist groß", "de"), (1001, "x" * 5000 + " das Haus", "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY, most_rows=20)
    assert model.languages == ["de", "en"]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY, most_rows=20, most_bytes=0)
    assert model.languages == []


def test_em_raises_the_likelihood():
    pieces = language.load(VOCABULARY)
    counts = [("x", w.encode(), 1) for w in "the cat sat on the mat with another cat".split()]
    counts = [("x", w, n) for w, n in {w: 1 for _, w, _ in counts}.items()]
    data = b"".join(w for _, w, _ in counts)
    ends = np.cumsum([len(w) for _, w, _ in counts])
    starts = ends - [len(w) for _, w, _ in counts]
    like = [language.train(pieces, counts, rounds=r, smoothing=1e-6).score(pieces, np.frombuffer(data, np.uint8), starts, ends).sum() for r in (1, 2, 4, 8)]
    assert like == sorted(like)


def test_language_held_out_accuracy(spark):
    rows = queries.op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    apart = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in apart) / len(apart) > 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !? 34", "en"), (4, "the cat " * 20000, "en"), (5, "das Haus ist groß", "de"), (5, "das Haus ist groß", "de"), (6, "a" * 3000, None), (7, "漢", None), (8, "、", None)], "doc_id long, text string, lang string")
    model = language.fit(df, VOCABULARY)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(df.withColumn("score", F.lit("x")), model, VOCABULARY).collect()]
    assert [p for i, p, _ in sorted(got)][:6] == ["und", "und", "und", "en", "de", "de"]
    assert dict((i, p) for i, p, _ in got)[8] == "und" and dict((i, p) for i, p, _ in got)[7] in ("en", "de")
    assert all(0 <= s <= 1 for _, _, s in got)
    none = language.fit(df.limit(0), VOCABULARY)
    assert {r.lang_pred for r in language.predict(df, none, VOCABULARY).collect()} == {"und"}
