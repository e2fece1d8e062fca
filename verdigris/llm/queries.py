"""One query for each operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bpe, conversations, extraction, filters, language, media, mixing, mtree, neardup, outliers, quality, substrings, warc
from verdigris.llm.store import clean  # noqa: F401  for the driver contract


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern, keep=["doc_id"])
    back = bpe.decode(ids, ranks, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = extraction.extract(pages, extraction.fit(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: Below this score a document is rejected.
QUALITY_THRESHOLD = 0.3


def quality_scores(documents: DataFrame, labels: DataFrame, learn_from: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scores of ``documents`` by weights learnt from the labels of ``learn_from`` that aren't held out."""
    weights = quality.fit(learn_from, labels.filter(~quality.held_out(F.col("doc_id"), 5, 0)))
    return quality.score(documents, weights, keep=keep)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = quality_scores(documents, _table(spark, sf_dir, "labels"), documents, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP4_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    media_of = media.store_text(docs, keep=["doc_id", "n_bytes"])
    read = media.read_payload(media.media_info(media_of))
    first, last = F.element_at("info.keyframes", 1), F.element_at("info.keyframes", -1)
    feature = F.format_string("%s %s %.6f s, %d samples, %d keyframes, first %d+%d, last %d+%d", "info.kind", "info.codec", "info.duration", "info.n_samples", F.size("info.keyframes"), first["offset"], first["length"], last["offset"], last["length"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.passes, round(b.target)::BIGINT - b.passes * b.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS earlier
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (passes * size + least(size, greatest(0, rest - earlier)))::BIGINT AS taken FROM p
"""

def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, vocabulary = _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    apart = F.coalesce(quality.held_out(F.col("doc_id"), 4, 2), F.lit(False))
    model = language.fit(documents.filter(~apart), vocabulary)
    found = language.predict(documents, model, vocabulary, keep=["doc_id"])
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), payloads=False)
    number = lambda c: F.substring(c, len(warc.RECORD_URN) + 1, 40).try_cast("long")  # noqa: E731  # a null id has no digits
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "error")


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(payload) AS h FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, (5 * i) // 4 + 1, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to, NULL::VARCHAR AS error FROM h
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM placed WHERE k > 1),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM each e WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = e.doc_id AND c.i = e.i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * p.c >= 85 * (u.n + v.n - p.c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x),
m AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)
"""


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.withColumn("distance", F.round("distance", 6))


_MOMENTS = "count(*) AS n, " + ", ".join([f"sum(x{i}) AS s{i}" for i in range(5)] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(5) for j in range(i + 1)])
_AGAIN = "sum(n) AS n, " + ", ".join([f"sum(s{i}) AS s{i}" for i in range(5)] + [f"sum(s{i}{j}) AS s{i}{j}" for i in range(5) for j in range(i + 1)])
_SQUARES = [(512 * x) ** 2 for x in (0.5, 0.05, 0.04, 0.7, 0.12)]


def _cholesky() -> str:
    out = [f"s{i} / n AS m{i}" for i in range(5)]
    for i in range(5):
        for j in range(i + 1):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            entry = f"s{i}{j} / n - m{i} * m{j}"
            out.append(f"sqrt(greatest({entry}, 0) + {_SQUARES[i]!r}::DOUBLE{rest}) AS l{i}{i}" if i == j else f"({entry}{rest}) / l{j}{j} AS l{i}{j}")
    return ", ".join(out)


_FORWARD = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in range(5)) + ", sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(5)) + ") AS d"
_STEPS = ",\n".join(
    f"""h{t} AS MATERIALIZED (SELECT gid, start, least(floor(32 * d), 4095) AS rng, {_MOMENTS} FROM (SELECT gid, start, x0, x1, x2, x3, x4, {_FORWARD} FROM x JOIN e{t - 1} USING (gid)) GROUP BY ALL),
p{t} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY gid, start ORDER BY rng) AS up_to, sum(n) OVER (PARTITION BY gid, start) AS total FROM h{t}),
e{t} AS MATERIALIZED (SELECT gid, start, {_cholesky()} FROM (SELECT gid, start, {_AGAIN} FROM p{t} WHERE up_to - n < 0.75 * total GROUP BY ALL))"""
    for t in range(1, 7)
)

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
cov AS (SELECT r, count(DISTINCT p) AS again FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words, r FROM d JOIN l USING (r) LEFT JOIN cov USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
g AS (SELECT lang, source, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
q AS (SELECT *, sum(CASE WHEN n < 100 THEN n END) OVER (PARTITION BY lang) AS rest FROM g),
o AS (SELECT coalesce(sum(n) FILTER (WHERE n < 100 AND rest < 100), 0) AS last FROM q),
k AS (SELECT lang, source, CASE WHEN n >= 100 THEN '1|' || coalesce('=' || lang, '') || '|' || coalesce('=' || source, '') WHEN rest >= 100 THEN '2|' || coalesce('=' || lang, '') WHEN last >= 100 THEN '3' END AS gid FROM q, o),
v AS MATERIALIZED (SELECT b.*, CASE WHEN NOT base_failed THEN gid END AS gid, CASE WHEN NOT base_failed THEN floor(512 * ln(n_words::DOUBLE) + 0.5)::BIGINT END AS x0, CASE WHEN NOT base_failed THEN floor(512 * ln((word_chars + 250) / (n_words + 50)) + 0.5)::BIGINT END AS x1,
  floor(512 * sqrt(n_symbols / (word_chars + 250)) + 0.5)::BIGINT AS x2, floor(512 * ln((n_dup_lines + 1)::DOUBLE) + 0.5)::BIGINT AS x3, floor(512 * sqrt(n_repeat_words / (n_words + 50)) + 0.5)::BIGINT AS x4
  FROM b LEFT JOIN k ON b.lang IS NOT DISTINCT FROM k.lang AND b.source IS NOT DISTINCT FROM k.source),
x AS MATERIALIZED (SELECT gid, x0, x1, x2, x3, x4 FROM v WHERE gid IS NOT NULL),
{", ".join(f"r{i} AS (SELECT gid, min(x{i}) FILTER (WHERE 4 * r >= n) AS q1, min(x{i}) FILTER (WHERE 4 * r >= 2 * n) AS m{i}, min(x{i}) FILTER (WHERE 4 * r >= 3 * n) AS q3, sqrt(((q3 - q1) / 1.349::DOUBLE) * ((q3 - q1) / 1.349::DOUBLE) + {_SQUARES[i]!r}::DOUBLE) AS l{i}{i} FROM (SELECT gid, x{i}, row_number() OVER (PARTITION BY gid ORDER BY x{i}) AS r, count(*) OVER (PARTITION BY gid) AS n FROM x) GROUP BY gid)" for i in range(5))},
e0 AS MATERIALIZED (SELECT gid, 0 AS start, {", ".join(f"m{i}::DOUBLE AS m{i}" for i in range(5))}, {", ".join(f"l{i}{i}" if i == j else f"0::DOUBLE AS l{i}{j}" for i in range(5) for j in range(i + 1))} FROM r0 JOIN r1 USING (gid) JOIN r2 USING (gid) JOIN r3 USING (gid) JOIN r4 USING (gid)
  UNION ALL SELECT gid, 1, {_cholesky()} FROM (SELECT gid, {_MOMENTS} FROM x GROUP BY gid)),
{_STEPS},
best AS (SELECT * FROM e6 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY l00 * l11 * l22 * l33 * l44, start) = 1),
far AS (SELECT v.r, {_FORWARD} FROM v JOIN best USING (gid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(d * sqrt(0.7058::DOUBLE), 6) AS distance, NOT base_failed AND coalesce(d * sqrt(0.7058::DOUBLE) <= 4.5, true) AS kept FROM v LEFT JOIN far USING (r)
"""


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, x.k, y.k, z.k] AS ks FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.k, b.k, x.k, y.k, z.k])) = 5),
s AS (SELECT ks, array_to_string(list_transform(ks, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
e AS (SELECT part, filter_order, step, ks[step] AS k, n, good, toxic, fails[ks[step]] AS now, len(list_filter(ks[1:step - 1], lambda k: fails[k])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS failed FROM c, s),
r AS (SELECT part, filter_order, step, k, sum(n) FILTER (WHERE NOT now AND NOT earlier) AS kept, sum(n) FILTER (WHERE now AND NOT earlier) AS removed, sum(n) FILTER (WHERE now AND earlier) AS redundant,
      sum(n) FILTER (WHERE now AND failed = 1) AS unique_fails, sum(n) FILTER (WHERE now AND NOT earlier AND good) AS good_lost, sum(n) FILTER (WHERE now AND NOT earlier AND toxic) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley FROM r
"""

def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows), ids=rows)


def _plus(state: str, cost: str, letters: str) -> str:
    """A carried string, its cost in nine digits before the audit letters, after an edit."""
    return f"(lpad((substr({state}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letters}')"


def _closed(z: str, s: str, u: str, a: str) -> str:
    """A layer of the four states closed by inserted messages."""
    return f"""{z} AS z, {s} AS s, least({u}, {_plus(z, '2', 'I')}, {_plus(s, '2', 'I')}, {_plus(a, '2', 'I')}) AS u, least({a}, {_plus(u, '2', 'I')}, {_plus(z, '4', 'II')}, {_plus(s, '4', 'II')}) AS a"""


_BEFORE_U, _KEEP, _GIVE = "least(z, s, a)", "CASE WHEN NOT gone AND initial = '{}' THEN {} END", "CASE WHEN NOT gone THEN {} END"


def _layer() -> str:
    """A turn's four states before inserts."""
    z = _plus("z", "3", "D")
    s = f"least({_plus('s', '3', 'D')}, {_KEEP.format('s', _plus('z', 'cut', 'K'))})"
    u = f"least({_plus('u', '3', 'D')}, {_KEEP.format('u', _plus(_BEFORE_U, 'cut', 'K'))}, {_GIVE.format(_plus(_BEFORE_U, '2 + cut', 'R'))})"
    a = f"least({_plus('a', '3', 'D')}, {_KEEP.format('a', _plus('u', 'cut', 'K'))}, {_GIVE.format(_plus('u', '2 + cut', 'R'))})"
    return f"{z} AS z, {s} AS s, {u} AS u, {a} AS a"


OP13_SQL = rf"""
WITH RECURSIVE hex AS (SELECT unnest(range(256)) AS c), crc_table AS (SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce(list_prepend(c, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM hex)),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1])), 4294967295) % 20 AS kind FROM n, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM o),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS trunc, last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au') AS ill FROM p),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE ill) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
e AS MATERIALIZED (SELECT conv_id, i, initial, blank OR dup AS gone, trunc::INTEGER AS cut FROM f),
v AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS z, NULL::VARCHAR AS s, '000000002I' AS u, '000000004II' AS a FROM counts
  UNION ALL SELECT conv_id, i, {_closed('z', 's', 'u', 'a')} FROM (SELECT conv_id, i, {_layer()} FROM (SELECT v.conv_id, e.i, z, s, u, a, initial, gone, cut FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i + 1))),
best AS (SELECT v.conv_id, least(z, a) AS b FROM v JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = c.rows),
audits AS (SELECT conv_id, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit FROM best),
letters AS (SELECT conv_id, k, substr(audit, k, 1) AS c, k - length(replace(substr(audit, 1, k), 'I', '')) AS inserted, k - length(replace(substr(audit, 1, k), 'D', '')) AS deleted FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)),
said AS (SELECT l.conv_id, k, k - deleted AS place, c, f.initial, f.role, f.text FROM letters l LEFT JOIN f ON c <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = k - inserted WHERE c <> 'D'),
moved AS (SELECT *, max(CASE WHEN place = 1 AND c = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM said),
lines AS (SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body FROM moved GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

QUERIES = {"op1_bpe": op1_bpe, "op2_extraction": op2_extraction, "op3_quality": op3_quality, "op4_topk": op4_topk, "op5_media": op5_media, "op6_mixing": op6_mixing, "op7_language": op7_language, "op8_warc": op8_warc, "op9_substrings": op9_substrings, "op10_neardup": op10_neardup, "op11_outliers": op11_outliers, "op12_filters": op12_filters, "op13_conversations": op13_conversations}
ORACLE_SQL: dict[str, str] = {"op4_topk": OP4_SQL, "op6_mixing": OP6_SQL, "op8_warc": OP8_SQL, "op9_substrings": OP9_SQL, "op10_neardup": OP10_SQL, "op11_outliers": OP11_SQL, "op12_filters": OP12_SQL, "op13_conversations": OP13_SQL}
