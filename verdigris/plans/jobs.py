"""Queries of whole jobs: builders, logs, documents, reports and probes over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import abtests, items, judges, quality, samples, scorers, tokens
from verdigris.plans import evaluation
from verdigris.plans.adapters import MATRIX, RATERS, RUNS, matrix, raters, runs
from verdigris.plans.catalogue import BOARD, BOOT, F1, GUARD, ORACLE_SQL, VERDICTS, _verdicts, chrf_sql, query, ranks_sql
from verdigris.schemas import HEADLINE, RECORD, RESULT
from verdigris.sources import concatenated, endpoint, readers, sinks
from verdigris.tables import scratch, table

#: Sentences of documents as instruct pairs, each once: the text, and the text without vowels.
SENTENCES = r"""parts AS (SELECT lang, source, trim(unnest(string_split(text, '.')), ' ' || chr(10)) AS input FROM documents),
pairs AS (SELECT input, translate(input, 'aeiou', '') AS output, lang AS category, source FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY source, lang) AS k FROM parts) WHERE k = 1)"""


def sentence_pairs(spark, sf_dir, task="c2m"):
    parts = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.split("text", r"\.")).alias("part"))
    clean = F.trim("part", F.lit(" \n"))
    each = parts.select(F.lit(task).alias("task"), clean.alias("input"), F.translate(clean, "aeiou", "").alias("output"), F.col("lang").alias("category"), "source", F.lit(False).alias("_has_box"))
    return samples.first_by(each, ["input"], [F.col("source"), F.col("category")])


def drawn_sql(seed: int, key: str) -> str:
    return f"md5('{seed}|' || coalesce({key}, ''))"


@query(f"""WITH {RATERS}, la AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM raters WHERE event_id % 2 = 0 AND a IS NOT NULL),
lb AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM raters WHERE event_id % 2 = 1 AND b IS NOT NULL)
SELECT la.user_id, la.event_type, la.a AS a, lb.b AS b FROM la JOIN lb ON la.user_id = lb.user_id AND la.event_type = lb.event_type WHERE la.k = 1 AND lb.k = 1""")
def judge_log_join(spark, sf_dir):
    """Two judges' logs, the last score of each item, where both have one."""
    rows = raters(spark, sf_dir)
    one = rows.filter("event_id % 2 = 0").withColumn("judge", F.col("a"))
    other = rows.filter("event_id % 2 = 1").withColumn("judge", F.col("b"))
    return judges.paired_logs(one, other, ["user_id", "event_type"], "event_id")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def pair_scenarios(spark, sf_dir):
    pairs, scenarios = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation")
    return abtests.with_lookup(pairs, scenarios.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("s_suppkey", "s_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def prompt_questions(spark, sf_dir):
    prompts, questions = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    return abtests.with_lookup(prompts, questions.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", strict=False).select("o_orderkey", "o_custkey", "c_mktsegment")


@query(f"""WITH c AS (SELECT lang, d.tokenizer, d.chars_per_token FROM ({ORACLE_SQL['token_density']}) d), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY chars_per_token, tokenizer) AS place, count(*) OVER (PARTITION BY lang) AS n FROM c)
SELECT lang, tokenizer, chars_per_token, place::INTEGER AS place, max(tokenizer) FILTER (WHERE place = 1) OVER (PARTITION BY lang) AS best, max(tokenizer) FILTER (WHERE place = n) OVER (PARTITION BY lang) AS worst FROM r""")
def tokenizer_ranking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", "text")
    return tokens.ranked(tokens.density(tokens.token_counts(docs, ["lang"], ["text"]), ["lang", "tokenizer"]), "chars_per_token", ["lang"])


@query("SELECT task, model, event_id FROM (SELECT event_type AS task, user_id % 20 AS model, event_id, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id) AS k FROM events) WHERE k <= 5 AND task IN ('purchase', 'click') AND model IN (1, 2, 3)")
def selected_items(spark, sf_dir):
    """A run's limit, tasks and models."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), (F.col("user_id") % 20).alias("model"), "event_id")
    return samples.selected(rows, ["purchase", "click"], [1, 2, 3], 5, "event_id")


NOW = "2024-01-01 00:00:00"


@query(f"""WITH {MATRIX}, m AS (SELECT model, task, round(avg(score), 6) AS mean FROM matrix GROUP BY ALL), old AS (SELECT * FROM m WHERE task <> 'R' AND model <> 3), new AS (SELECT model, task, mean + 1 AS mean FROM m WHERE task <> 'A' AND model % 2 = 1)
SELECT model, task, mean, CASE WHEN model = 3 THEN '{NOW}' ELSE 'before' END AS started_at, CASE WHEN model % 2 = 1 AND model <> 3 THEN '{NOW}' END AS last_updated_at FROM new
UNION ALL SELECT model, task, mean, 'before', CASE WHEN model % 2 = 1 THEN '{NOW}' END FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.model = old.model AND new.task = old.task)""")
def document_upsert(spark, sf_dir):
    """Documents of models after a run of some tasks: other tasks stay, times are kept and set, an unreadable document starts anew."""
    means = matrix(spark, sf_dir).groupBy("model", "task").agg(F.round(F.avg("score"), 6).alias("mean"))
    docs = lambda df, *more: df.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("task", "mean"))).alias("tasks")).select("model", F.lit("u").alias("base_url"), *more, "tasks")
    start, update = F.lit("before").alias("started_at"), F.lit(None).cast("string").alias("last_updated_at")
    old = docs(means.filter("task <> 'R'"), start, update).withColumn("tasks", F.when(F.col("model") != 3, F.col("tasks")))
    out = sinks.updated_documents(old, docs(means.filter("task <> 'A' AND model % 2 = 1").withColumn("mean", F.col("mean") + 1)), NOW)
    return out.select("model", F.explode("tasks").alias("task", "mean"), "started_at", "last_updated_at")


@query("SELECT conv_id, turn FROM conversations WHERE coalesce(CASE WHEN turn % 5 = 0 THEN '__ERR__ ' || text WHEN turn % 7 = 0 THEN '' ELSE text END, '') <> '' AND NOT turn % 5 = 0 AND NOT conv_id % 11 = 0")
def answered_rows(spark, sf_dir):
    answer = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("__ERR__ "), "text")).when(F.col("turn") % 7 == 0, "").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), F.when(F.col("conv_id") % 11 == 0, "timeout").alias("error"))
    return samples.answered(rows, "answer", "error").select("conv_id", "turn")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def member_semi(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return samples.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), poor, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT page_id, coalesce(url, '') AS prediction, length(coalesce(url, ''))::BIGINT AS prompt_tokens, NULL::VARCHAR AS error FROM pages")
def llm_stub(spark, sf_dir):
    """Predictions by the deterministic client, which repeats a prompt's last line."""
    asked = endpoint.predictions(table(spark, sf_dir, "pages").select("page_id", "url"), lambda: endpoint.stub, "url")
    return asked.select("page_id", "prediction", "prompt_tokens", "error")


@query("SELECT page_id, url AS judge_raw, CASE WHEN regexp_extract(url, '[0-5]', 0) <> '' THEN regexp_extract(url, '[0-5]', 0)::INTEGER END AS judge, CASE WHEN regexp_extract(url, '[0-5]', 0) = '' THEN 'reply refused' END AS judge_error FROM pages")
def judge_stub(spark, sf_dir):
    """A judge whose reply is the judged text: its first digit is the score; replies without one are asked again."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("i").alias("input"), F.lit("r").alias("reference"), F.col("url").alias("prediction"))
    found = judges.scored(rows, lambda: endpoint.stub, "{input} {reference}\n{prediction}", endpoint.Settings(wait=0.0))
    return found.select("page_id", "judge_raw", "judge", "judge_error")


MEANS = f"WITH {MATRIX}, m AS (SELECT model, task, avg(score) AS mean FROM matrix GROUP BY ALL)"


@query(f"WITH {MATRIX}, {BOARD}, {BOOT}, k AS (SELECT model, task, m, row_number() OVER (PARTITION BY model, task ORDER BY m) AS k FROM m), e AS (SELECT model, task, round((max(m) FILTER (WHERE k = 1950) - max(m) FILTER (WHERE k = 51)) / 2, 4) AS half_width FROM k GROUP BY ALL) SELECT model, task, mean, half_width, avg, place::INTEGER AS place FROM means JOIN b USING (model) LEFT JOIN e USING (model, task)")
def leaderboard_intervals(spark, sf_dir):
    """The board with the half-width of each mean's interval."""
    scores = matrix(spark, sf_dir)
    means = scores.groupBy("model", "task").agg(F.round(F.avg("score"), 4).alias("mean"))
    return items.leaderboard(means, items.bootstrap_ci(scores, ["model", "task"])).select("model", "task", "mean", "half_width", "avg", "place")


@query("SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang, source")
def remembered_lengths(spark, sf_dir):
    """Sums that a memo keeps: a first run makes some of them, a second one the others."""
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "memo")
    make = lambda work: docs.join(work, ["lang", "source"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    work = docs.select("lang", "source").distinct()
    sinks.remembered(work.filter("lang = 'en'"), path, ["lang", "source"], make)
    return sinks.remembered(work, path, ["lang", "source"], make)


#: Latin letters as Han characters, none of them a function word, for builders that look for these.
LATIN, CJK = "abcdefghijklmnopqrstuvwxyz", "山水火木金土日月星云雨风雷电石田禾米竹花草鸟鱼马牛羊"
HAN_TEXT = f"translate(text, '{LATIN}.', '{CJK}。')"


def han_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.translate("text", LATIN + ".", CJK + "。").alias("content"))


@query(rf"""WITH p AS (SELECT unnest(string_split({HAN_TEXT}, '。')) AS s FROM documents WHERE source IN ('src1', 'src2', 'src3')),
c AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(s, '【.*?】', '', 'g'), '[(（].*?[)）]', '', 'g'), '\s+', '', 'g') AS t FROM p), h AS (SELECT t FROM c WHERE length(regexp_replace(t, '[^{CJK}]', '', 'g')) BETWEEN 8 AND 25),
l AS (SELECT t, list_filter(range(2, length(t)), lambda i: contains('{CJK}', substr(t, i, 1)) AND length(t) - length(replace(t, substr(t, i, 1), '')) = 1) AS places FROM h),
m AS (SELECT t, places[len(places) // 2 + 1] AS place FROM l WHERE len(places) > 0), s AS (SELECT * FROM m ORDER BY {drawn_sql(42, 't')}, t LIMIT 100)
SELECT 'fill-in#' || row_number() OVER (ORDER BY {drawn_sql(43, 't')}, t) AS id, substr(t, 1, place - 1) || '___' || substr(t, place + 1) AS input, substr(t, place, 1) AS reference, t AS context FROM s""")
def cloze_records(spark, sf_dir):
    """The builder of cloze records on whole documents of some sources."""
    made = samples.build_cloze(han_texts(spark, sf_dir), ["src1", "src2", "src3"])
    return made.select("id", "input", "reference", F.col("metadata")["context"].alias("context"))


@query(rf"""WITH t AS (SELECT {HAN_TEXT} AS input, lang AS category FROM documents), d AS (SELECT input, translate(input, '山水火木金土日月', '') AS output, min(category) AS category FROM t GROUP BY input),
n AS (SELECT *, length(regexp_replace(input, '[^{CJK}]', '', 'g')) AS m, length(regexp_replace(output, '[^{CJK}]', '', 'g')) AS c FROM d), g AS (SELECT * FROM n WHERE m BETWEEN 100 AND 300 AND c BETWEEN 30 AND m AND c / greatest(m, 1) BETWEEN 0.30 AND 0.75),
q(category, want) AS (VALUES ('en', 25), ('de', 35)), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {drawn_sql(42, 'input')}, input) AS k FROM g),
a AS (SELECT r.* FROM r JOIN q USING (category) WHERE k <= want), b AS (SELECT * FROM r WHERE category NOT IN (SELECT category FROM q) ORDER BY {drawn_sql(42, 'input')}, input LIMIT (100 - (SELECT count(*) FROM a))),
u AS (SELECT input, output, category, m, c FROM a UNION ALL SELECT input, output, category, m, c FROM b)
SELECT 'compress#' || row_number() OVER (ORDER BY {drawn_sql(43, 'input')}, input) AS id, input, output AS reference, category, round(c / m, 4) AS ref_ratio FROM u""")
def compress_records(spark, sf_dir):
    """The builder of compression records on whole documents, each text once, without eight of its letters as the short form."""
    texts = han_texts(spark, sf_dir).groupBy("content").agg(F.min("lang").alias("category"))
    pairs = texts.select(F.lit("m2c").alias("task"), F.col("content").alias("input"), F.translate("content", "山水火木金土日月", "").alias("output"), "category", F.lit("s").alias("source"), F.lit(False).alias("_has_box"))
    made = samples.build_compress(pairs, {"en": 25, "de": 35})
    return made.select("id", "input", "reference", F.col("metadata")["category"].alias("category"), F.col("metadata")["ref_ratio"].cast("double").alias("ref_ratio"))


@query(f"""{MEANS}, p AS (SELECT a.task || '|' || b.task AS k, a.mean AS u, b.mean AS v FROM m a JOIN m b ON a.model = b.model AND a.task < b.task),
r AS (SELECT split_part(k, '|', 1) AS task_a, split_part(k, '|', 2) AS task_b, count(*) AS n, round({GUARD.format(n=3)}, 3) AS rho FROM ({ranks_sql('p', 'k', 'u', 'v')}) GROUP BY k)
SELECT *, coalesce(abs(rho) >= 0.1, false) AS redundant FROM r UNION ALL SELECT task, task, count(*), 1.0, false FROM m GROUP BY task""")
def redundancy_matrix(spark, sf_dir):
    """With a low bar, for these tables' tasks hardly rank models alike."""
    return items.redundancy_matrix(matrix(spark, sf_dir).groupBy("model", "task").agg(F.avg("score").alias("mean")), flagged=0.1)


PROBE_RHO = lambda x, name: f"SELECT task, round({GUARD.format(n=4)}, 6) AS {name} FROM ({ranks_sql('(SELECT * FROM every WHERE ' + x + ' IS NOT NULL)', 'task', x, 'difficulty')}) GROUP BY task"


@query(rf"""WITH r AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'translate' WHEN item_id % 3 = 1 THEN 'idiom-source' ELSE 'char-gloss' END AS task, CASE WHEN item_id % 5 < 2 THEN 'top' WHEN item_id % 5 = 2 THEN 'second' WHEN item_id % 5 = 3 THEN 'other' END AS source, text, (item_id * 7 % 11) / 10.0 AS difficulty FROM benchmark),
s AS (SELECT *, CASE source WHEN 'top' THEN 3 WHEN 'second' THEN 2 ELSE 1 END AS tier, CASE WHEN task = 'idiom-source' THEN text ELSE regexp_replace(translate(text, '{X.SHINGLE_MARKS.replace("'", "''")}', ''), '\s+', '', 'g') END AS t FROM r WHERE source IS NOT NULL AND task <> 'char-gloss'),
p AS (SELECT *, CASE WHEN length(t) >= 10 THEN substr(t, (length(t) - 10) // 2 + 1, 10) ELSE t END AS shingle FROM s),
h AS (SELECT shingle, sum((length(d.text) - length(replace(d.text, shingle, ''))) // length(shingle)) AS hits FROM (SELECT DISTINCT shingle FROM p WHERE shingle <> '') JOIN documents d ON contains(d.text, shingle) GROUP BY ALL),
g AS (SELECT task, tier, difficulty, CASE WHEN shingle <> '' THEN ln(1 + coalesce(hits, 0)) END AS lg FROM p LEFT JOIN h USING (shingle)),
every AS (SELECT * FROM g UNION ALL SELECT '', tier, difficulty, lg FROM g),
t AS (SELECT task, count(*) AS n, {', '.join(f"round(avg(difficulty) FILTER (WHERE tier = {k}), 4) AS mean_{k}, count(*) FILTER (WHERE tier = {k}) AS n_{k}" for k in (1, 2, 3))} FROM every GROUP BY task),
a AS ({PROBE_RHO('tier', 'rho_canonicity')}), b AS ({PROBE_RHO('lg', 'rho_shingle')})
SELECT nullif(t.task, '') AS task, n, rho_canonicity, rho_shingle, mean_1, n_1, mean_2, n_2, mean_3, n_3, round(mean_3 - mean_1, 4) AS gap,
  CASE WHEN rho_canonicity >= 0.30 THEN 'recall-driven' WHEN abs(rho_canonicity) < 0.15 THEN 'clean' WHEN rho_canonicity IS NOT NULL THEN 'mixed' END AS class FROM t LEFT JOIN a USING (task) LEFT JOIN b USING (task)""")
def contamination_probe(spark, sf_dir):
    """The probe from records to classes, the benchmark's texts against all documents."""
    i = F.col("item_id")
    bench = table(spark, sf_dir, "benchmark")
    source = F.when(i % 5 < 2, "top").when(i % 5 == 2, "second").when(i % 5 == 3, "other")
    task = F.when(i % 3 == 0, "translate").when(i % 3 == 1, "idiom-source").otherwise("char-gloss")
    metadata = F.map_from_arrays(F.array(F.lit("source"), F.lit("expected_quote")), F.array(source, F.col("text")))
    records = bench.select(i.cast("string").alias("id"), task.alias("task"), F.col("text").alias("reference"), metadata.alias("metadata"))
    difficulty = bench.select(i.cast("string").alias("id"), task.alias("task"), ((i * 7 % 11) / 10.0).alias("difficulty"))
    found = items.probe(records, difficulty, table(spark, sf_dir, "documents").select("text"), "text", top=("top",), second=("second",))
    return found.withColumns({c: F.round(c, 6) for c in ("rho_canonicity", "rho_shingle")})


@query(f"""WITH {RUNS}, {VERDICTS}, p AS (SELECT model, question, max(prompt_chars) FILTER (WHERE version = 'modern') AS m, max(prompt_chars) FILTER (WHERE version = 'classical') AS c FROM runs GROUP BY ALL), r AS (SELECT model, m / c AS r FROM p WHERE m IS NOT NULL AND c IS NOT NULL),
a AS (SELECT model, count(r) AS n, round(avg(r), 4) AS ratio_mean, round(median(r), 4) AS ratio_median, round((1 - 1 / avg(r)) * 100, 4) AS saved_pct FROM r GROUP BY ALL),
w AS (SELECT model, count(winner) AS judged, count(*) FILTER (WHERE winner = 'idiom') AS wins, count(*) FILTER (WHERE winner = 'tie') AS ties, count(*) FILTER (WHERE winner = 'literal') AS losses FROM v GROUP BY ALL), x AS (SELECT *, round((wins + ties) / nullif(judged, 0), 4) AS not_loss FROM w)
SELECT *, CASE WHEN saved_pct < 20 THEN 'no saving' WHEN not_loss >= 0.7 THEN 'adopt' WHEN not_loss >= 0.5 THEN 'trade-off' ELSE 'reject' END AS decision FROM a LEFT JOIN x USING (model)""")
def ab_report(spark, sf_dir):
    both = abtests.paired(runs(spark, sf_dir), ["model", "question"], "version", "modern", "classical", ["prompt_chars"])
    return abtests.report(both, _verdicts(spark, sf_dir), ["model"], "prompt_chars_modern", "prompt_chars_classical")


@query(f"""WITH {RUNS}, p AS (SELECT model, question, max(prompt_chars) FILTER (WHERE version = 'modern') AS m, max(prompt_chars) FILTER (WHERE version = 'classical') AS c FROM runs GROUP BY ALL)
SELECT model, question, round(m / c, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY m / c DESC, question) AS k FROM p WHERE m / c IS NOT NULL) WHERE k <= 5""")
def ab_top_savings(spark, sf_dir):
    both = abtests.paired(runs(spark, sf_dir), ["model", "question"], "version", "modern", "classical", ["prompt_chars"])
    return abtests.top_savings(both, ["model"], "question", "prompt_chars_modern", "prompt_chars_classical").withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {MATRIX} SELECT model, 'fill-in' AS task, 'exact_match' AS metric, round(avg((id LIKE 'Brand#1%')::INT), 4) AS mean FROM matrix WHERE task = 'A' AND id <> 'Brand#55' GROUP BY model
UNION ALL SELECT model, 'fill-in', 'in_pred', round(avg(contains(id, '1')::INT), 4) FROM matrix WHERE task = 'A' AND id <> 'Brand#55' GROUP BY model
UNION ALL SELECT model, 'fill-in', 'judge_n', 7.0 FROM matrix WHERE task = 'A' AND id <> 'Brand#55' GROUP BY model""")
def rescore_summary(spark, sf_dir):
    """Brands as answers whose right one is 1, scored again: the new summary with the old one's count of judged items. One brand has no record."""
    rows = matrix(spark, sf_dir).filter("task = 'A'").select("model", F.lit("fill-in").alias("task"), "id")
    answer = F.regexp_replace("id", "Brand#", "")
    stored = rows.select("model", "task", "id", answer.alias("prediction"), F.create_map(F.lit("exact_match"), F.lit(0.5)).alias("scores"))
    bare = F.lit(None).cast("map<string,string>")
    records = rows.select("id").distinct().filter("id <> 'Brand#55'").select("id", F.lit("").alias("input"), F.lit("1").alias("reference"), bare.alias("metadata"))
    old = rows.select("model", "task").distinct().select("model", "task", F.inline(F.array(F.struct(F.lit("judge_n").alias("metric"), F.lit(7.0).alias("mean")), F.struct(F.lit("exact_match").alias("metric"), F.lit(0.5).alias("mean")))))
    return scorers.rescored_documents(stored, records, scorers.Scorers(compose=False, letters="0-9"), old)[1]


@query("""WITH j AS (SELECT source AS task, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), m AS (SELECT task, round(avg(quality / 5), 4) AS mean, count(*)::DOUBLE AS n FROM j GROUP BY ALL)
SELECT task, 'judge_b_norm' AS metric, mean AS value FROM m UNION ALL SELECT task, 'judge_b_n', n FROM m""")
def judge_backfill_summary(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task")), table(spark, sf_dir, "labels")
    return judges.backfill_summary(docs, labels.withColumnRenamed("quality", "judge"), "judge_b", ["task"], ["doc_id"])


@query("""WITH q AS (SELECT doc_id AS id, list_distinct(string_split(coalesce(text, ''), '')) AS a, list_distinct(string_split(coalesce(substr(text, 1, length(text) // 3), ''), '')) AS b FROM documents)
SELECT id, round(len(list_intersect(list_filter(a, lambda x: x <> ''), b)) / greatest(len(list_filter(a, lambda x: x <> '')), 1), 6) AS overlap FROM q""")
def quote_overlap(spark, sf_dir):
    """Whole texts against quotes of them, their first thirds."""
    third = F.substring("text", F.lit(1), F.floor(F.char_length("text") / 3).cast("int"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("idiom-source").alias("task"), F.col("text").alias("input"), F.create_map(F.lit("expected_quote"), third).alias("metadata"))
    return quality.quote_overlap(records).withColumn("overlap", F.round("overlap", 6))


@query("SELECT lang AS task, source, n, round(share, 4) AS share, share > 0.06 AS dominant FROM (SELECT lang, source, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source)")
def source_balance(spark, sf_dir):
    return quality.source_balance(table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), "source"), F.col("source"), most=0.06)


@query(f"""WITH {SENTENCES}, g AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {drawn_sql(42, 'input')}, input) AS k FROM pairs WHERE length(input) BETWEEN 10 AND 60 AND category IN ('en', 'de'))
SELECT 'translate#' || row_number() OVER (ORDER BY {drawn_sql(43, 'input')}, input) AS id, input, output AS reference, category FROM g WHERE k <= 25""")
def translate_records(spark, sf_dir):
    """The builder of translation records on the sentences of all documents."""
    made = samples.build_translate(sentence_pairs(spark, sf_dir), ("en", "de"), 25)
    return made.select("id", "input", "reference", F.col("metadata")["category"].alias("category"))


@query(f"""WITH {SENTENCES}, g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {drawn_sql(42, 'input')}, input) AS k FROM (SELECT input, output, coalesce(source, '') AS source FROM pairs WHERE length(input) BETWEEN 30 AND 200)),
p AS (SELECT * FROM g WHERE k <= 100 ORDER BY k, source LIMIT 100), r AS (SELECT 'punctuate#' || row_number() OVER (ORDER BY {drawn_sql(43, 'input')}, input) AS id, trim(input) AS input, trim(ltrim(output, '{X.LEADING_NOISE}')) AS reference, source FROM p)
SELECT * FROM r WHERE input <> '' AND reference <> ''""")
def punctuate_records(spark, sf_dir):
    """The builder of punctuation records, sources in turn."""
    made = samples.build_punctuate(sentence_pairs(spark, sf_dir))
    return made.select("id", "input", "reference", F.col("metadata")["source"].alias("source"))


@query(f"""WITH {SENTENCES} SELECT output AS classical, input AS modern, coalesce(source, '?') AS source, coalesce(category, '?') AS category FROM pairs WHERE length(output) BETWEEN 40 AND 150 AND length(input) BETWEEN 60 AND 300 ORDER BY {drawn_sql(42, 'input')}, input LIMIT 30""")
def token_triples(spark, sf_dir):
    return samples.token_triples(sentence_pairs(spark, sf_dir, "m2c"))


@query(f"""WITH w AS (SELECT n_name AS word, 'R' || n_regionkey AS book, n_name || ' lies in region ' || n_regionkey AS quote FROM nation WHERE n_regionkey < 3 AND length(n_name) BETWEEN 3 AND 10)
SELECT 'idiom-source#' || row_number() OVER (ORDER BY {drawn_sql(43, 'word')}, word) AS id, word AS input, '出自《' || book || '》：「' || quote || '」' AS reference, book FROM w""")
def idiom_records(spark, sf_dir):
    """The builder of source records on nations, whose regions are the books."""
    book = F.concat(F.lit("《R"), "n_regionkey", F.lit("·x》"))
    quote = F.concat("n_name", F.lit(" lies in region "), "n_regionkey")
    idioms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.lit("e").alias("explanation"), F.struct(quote.alias("text"), book.alias("book")).alias("source"))
    made = samples.build_idiom_source(idioms, ["R0", "R1", "R2"])
    return made.select("id", "input", "reference", F.col("metadata")["book"].alias("book"))


@query("SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'candidate' ELSE 'blocked' END AS status, CASE WHEN toxic = 1 THEN 'n' || doc_id ELSE '同本义。' END AS reference FROM labels")
def gloss_candidates(spark, sf_dir):
    """Repaired candidates of flagged glosses: those whose character a dictionary has with a clean head."""
    labels = table(spark, sf_dir, "labels")
    char = F.concat(F.lit("c"), "doc_id")
    metadata = F.map_from_arrays(F.array(F.lit("char"), F.lit(quality.ISSUE)), F.array(char, F.lit(quality.CIRCULAR_ISSUE)))
    records = labels.select(F.col("doc_id").alias("id"), F.lit("char-gloss").alias("task"), F.lit("").alias("instruction"), F.lit("x").alias("input"), F.lit("同本义。").alias("reference"), metadata.alias("metadata"))
    entries = labels.filter("toxic = 1").select(char.alias("char"), F.concat(F.lit("n"), "doc_id", F.lit("也。从木，「x」聲。")).alias("content"), F.lit(1).alias("seq"))
    entries = entries.unionByName(labels.select(char.alias("char"), F.lit("a much longer head than any gloss").alias("content"), F.lit(2).alias("seq")))
    made = quality.repaired_candidates(records, entries)
    return made.select("id", F.col("_status").alias("status"), "reference")


#: Result documents with a fault of each kind, and what is said of them beside missing tasks: (task, item, severity, message).
FAULTY = [
    ("{broken", [(None, None, "error", "not valid JSON")]),
    ("[1]", [(None, None, "error", "top level is not an object")]),
    ('{"tasks": {}}', [(None, None, "error", "missing top-level key 'model'")]),
    ('{"model": null, "tasks": {}}', []),
    ('{"model": 1}', [(None, None, "error", "missing top-level key 'tasks'")]),
    ('{"model": 1, "tasks": [{}]}', [(None, None, "error", "'tasks' is not an object")]),
    ('{"model": 1, "tasks": {"translate": 3, "odd": {"items": 4}}}', [("translate", None, "error", "is not an object"), ("odd", None, "error", "unexpected task key")]),
    (
        '{"model": 1, "tasks": {"compress": {"summary": [], "items": [{"id": 1, "scores": {}}, 4]}, "fill-in": {"items": null, "summary": {}}}}',
        [("compress", None, "error", "summary missing or not an object"), ("compress", None, "warn", "2/100 items"), ("compress", 0, "error", "missing 'prediction'"), ("compress", 1, "error", "is not an object"), ("fill-in", None, "error", "items missing or not a list")],
    ),
]


def _faulty_sql() -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = [f"({k}, {text(task)}, {'NULL' if item is None else item}, '{severity}', {text(message)})" for k, (_, said) in enumerate(FAULTY) for task, item, severity, message in said]
    rows += [f"({k}, '{task}', NULL, 'warn', 'missing task')" for k in (2, 3, 4, 6, 7) for task in HEADLINE if f'"{task}"' not in FAULTY[k][0]]
    return "SELECT page_id::VARCHAR AS file, f.task, f.item::INTEGER AS item, f.severity, f.message FROM pages JOIN (VALUES " + ", ".join(rows) + ") f(k, task, item, severity, message) ON page_id % 8 = f.k"


@query(_faulty_sql())
def document_checks(spark, sf_dir):
    """Result documents, each with one of the faults."""
    value = F.element_at(F.array(*[F.lit(text) for text, _ in FAULTY]), (F.col("page_id") % 8 + 1).cast("int"))
    return quality.document_violations(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), value.alias("value")))


@query("SELECT k, count(*) AS n FROM (SELECT regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY k")
def concat_json(spark, sf_dir):
    """Events' properties written one after another on long lines, and read back as concatenated objects."""
    path = scratch(spark, "concat")
    props = table(spark, sf_dir, "events").select("event_id", "props").groupBy(F.floor(F.col("event_id") / 500).alias("g"))
    props.agg(F.concat_ws(" and ", F.lit("junk {"), F.collect_list("props")).alias("value")).select("value").write.text(path)
    return concatenated.concatenated_json(spark, path, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, translate(text, 'éèêç', 'eeec') AS converted, contains(translate(text, 'éèêç', 'eeec'), 'treve') AS hit FROM documents")
def t2s_books(spark, sf_dir):
    """One-to-one characters converted, on both sides of a match."""
    table_of = dict(zip("éèêç", "eeec", strict=True))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", X.convert(F.col("text"), table_of).alias("converted"), X.book_hit(F.col("text"), F.lit("trêve"), {}, table_of).alias("hit"))


@query("SELECT item_id::VARCHAR AS id, 'translate' AS task, text AS reference, item_id % 3 AS part FROM benchmark")
def record_lines(spark, sf_dir):
    """Records written as JSON lines and read back by their schema."""
    path = scratch(spark, "records")
    bench = table(spark, sf_dir, "benchmark")
    part = F.create_map(F.lit("part"), (F.col("item_id") % 3).cast("string"))
    sinks.json_lines(bench.select(F.col("item_id").cast("string").alias("id"), F.lit("translate").alias("task"), F.lit(None).cast("string").alias("instruction"), F.lit("x").alias("input"), F.col("text").alias("reference"), part.alias("metadata")), path)
    return readers.json_lines(spark, path, RECORD).select("id", "task", "reference", F.col("metadata")["part"].cast("long").alias("part"))


@query(f"WITH {MATRIX} SELECT model::VARCHAR AS model, task, id, 'chrf' AS metric, score FROM matrix")
def result_documents(spark, sf_dir):
    """A document for each model, written and read back as the facts of all statistics."""
    path = scratch(spark, "results")
    none = F.lit(None).cast("string")
    item = F.struct("id", none.alias("input"), none.alias("reference"), none.alias("prediction"), F.create_map(F.lit("chrf"), "score").alias("scores"))
    tasks = matrix(spark, sf_dir).groupBy("model", "task").agg(F.collect_list(item).alias("items"))
    doc = F.struct("task", F.size("items").alias("n"), F.lit(0).alias("errors"), F.lit(0.0).alias("elapsed_sec"), F.create_map(F.lit("chrf"), F.lit(0.0)).alias("summary"), "items")
    docs = tasks.groupBy(F.col("model").cast("string").alias("model")).agg(F.map_from_entries(F.collect_list(F.struct("task", doc.alias("d")))).alias("tasks"))
    whole = docs.select("model", none.alias("base_url"), none.alias("started_at"), none.alias("last_updated_at"), "tasks", F.col("model").alias("_file"))
    text = whole.select("_file", F.to_json(F.struct(*[f.name for f in RESULT.fields])).alias("value"))
    text.repartition("_file").write.partitionBy("_file").text(path)
    return readers.item_scores(readers.results(spark, f"{path}/*")).select("model", "task", "id", "metric", "score")


@query("SELECT idiom, gloss FROM (SELECT n_name AS idiom, CASE WHEN n_nationkey % 2 = 0 THEN 'of ' || n_regionkey ELSE '' END AS gloss FROM nation)")
def seed_lines(spark, sf_dir):
    """Seeds written as lines with comments, blanks and repeats, and read back."""
    path = scratch(spark, "seeds")
    nation = table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(" | ", "n_name", F.concat(F.lit("of "), "n_regionkey"))).otherwise(F.col("n_name"))
    lines = F.explode(F.array(F.lit("# note"), line, F.lit(""), line))
    nation.select(lines.alias("value")).write.text(path)
    return readers.seeds(spark, path)


@query(rf"""WITH t AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS p, regexp_replace(replace(text, 'e', 'a'), '\s+', '', 'g') AS r FROM benchmark WHERE item_id % 10 <> 3
  UNION ALL SELECT item_id, '', regexp_replace(replace(text, 'e', 'a'), '\s+', '', 'g') FROM benchmark WHERE item_id % 10 = 3),
{chrf_sql('t', 'item_id', 'p', 'r')}, s AS (SELECT coalesce(chrf, 0) AS chrf, coalesce({F1}, 0) AS f1 FROM t LEFT JOIN f USING (item_id) LEFT JOIN (SELECT * FROM fo WHERE n = 1) USING (item_id)),
n AS (SELECT count(*)::INTEGER AS n, count(*) FILTER (WHERE item_id % 10 = 3)::INTEGER AS errors FROM benchmark)
SELECT 'stub' AS model, 'translate' AS task, n.n, errors, 'chrf' AS metric, (SELECT round(avg(chrf), 4) FROM s) AS mean FROM n UNION ALL SELECT 'stub', 'translate', n.n, errors, 'char_f1', (SELECT round(avg(f1), 4) FROM s) FROM n""")
def evaluation_run(spark, sf_dir):
    """A run of the deterministic client, which fails on some prompts, from records to a document's summary."""
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    given = F.when(F.col("item_id") % 10 == 3, F.concat(F.lit("FAIL "), text)).otherwise(text)
    bare = F.lit(None).cast("map<string,string>")
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("translate").alias("task"), F.lit("Repeat:").alias("instruction"), given.alias("input"), F.replace("text", F.lit("e"), F.lit("a")).alias("reference"), bare.alias("metadata"))

    def client(prompt: str) -> dict:
        if "FAIL" in prompt:
            raise ConnectionError("no answer")
        return endpoint.stub(prompt)

    rows = evaluation.answered(records, lambda: client, scorers.Scorers(compose=False), endpoint.Settings(wait=0.0))
    docs = evaluation.task_results(rows, F.lit("stub"), F.lit("http://localhost"))
    each = docs.select("model", F.explode("tasks").alias("task", "t"))
    return each.select("model", "task", "t.n", "t.errors", F.explode("t.summary").alias("metric", "mean"))
