"""Queries on languages, feedback, chunk statistics, topics, boundaries and entities, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions import languages
from docslice.functions import text as T
from docslice.operators import closed, feedback, profiles, topics
from docslice.plans.documents import _S, _TF, _docs, _sentences
from docslice.plans.splits import _char_sql
from docslice.runtime import table

ENTITIES = {"number": r"^[0-9]+[.,]?$", "name": r"^[A-Z][a-z]+[.,]?$", "marked": r"^[#@*]"}


def signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("strategy"), F.col("event_id").alias("at"), (F.col("value") / 100).alias("score"), (1 + F.col("event_id") % 3).cast("double").alias("weight"), F.col("event_type").alias("kind"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up runs, a row for each document."""
    d = _docs(spark, sf)
    return d.select("source", (F.length(T.filled(F.col("text"))) / 1000 + 1).cast("long").alias("chunks"), F.octet_length(T.filled(F.col("text"))).cast("long").alias("n_bytes"), ((F.col("doc_id") % 7 + 1) / 8).alias("seconds"))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up measures of strategies (brands) by size."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("strategy"), (F.col("p_size") % 5).cast("long").alias("file")).agg(F.count("*").cast("double").alias("seconds"), F.sum("p_size").cast("double").alias("mb_per_second"), F.max("p_size").cast("double").alias("memory_mb"), F.when(F.min("p_size") > 8, F.avg("p_size")).alias("quality"))


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    return closed.fixed_size(_docs(spark, sf), 500, 0, preserve_boundaries=True)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """A topic for each sentence by its length."""
    return _sentences(spark, sf).select("doc_id", "i", (F.length("sentence") % 3).cast("int").alias("topic"))


def with_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = _sentences(spark, sf).withColumn("k", F.floor(F.col("i") / 4).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    return s.groupBy("doc_id", F.col("k").alias("chunk_index")).agg(text.alias("content"), F.count("*").alias("sentences"))


def entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _sentences(spark, sf)
    joined = docs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("sentence", r"\s+", " ").alias("s")))), lambda x: x["s"]), " ").alias("text"))
    return topics.word_entities(joined, ENTITIES, "text")


def spaced(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).withColumn("sentence", F.regexp_replace("sentence", r"\s+", " "))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return topics.entity_sentences(entity_rows(spark, sf), topics.sentence_spans(spaced(spark, sf)))


def detected(spark: SparkSession, sf: str) -> DataFrame:
    return languages.detect(_docs(spark, sf))


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.octet_length(T.filled(F.col("text")))
    out = None
    for rule in ("buzhash", "tttd", "ml_cdc"):
        expected, share = profiles.expected_size(rule)
        e = profiles.estimate(n, expected, share, 1024 if rule == "ml_cdc" else 2048)
        some = _docs(spark, sf).select("doc_id", F.lit(rule).alias("rule"), *(v.alias(k) for k, v in e.items()))
        out = some if out is None else out.unionByName(some)
    return out


def divisors(spark: SparkSession, sf: str) -> DataFrame:
    by = fixed(spark, sf).groupBy("doc_id").agg(F.avg("size").alias("mean"), F.count("*").alias("n"))
    d = profiles.new_divisors(F.col("mean"), 380, F.lit(1024) + F.col("doc_id") * 40, F.lit(4096) + F.col("doc_id") * 160, F.col("n"), 3)
    return by.select("doc_id", *(v.alias(k) for k, v in d.items()))


def progressed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    got = feedback.progress(F.col("p_partkey") * 1000, F.col("p_partkey") * 1000 + F.col("p_size") * 50000, (F.col("p_size") % 9).cast("double"))
    return p.select("p_partkey", *(v.alias(k) for k, v in got.items()))


def advised(spark: SparkSession, sf: str) -> DataFrame:
    return detected(spark, sf).select("doc_id", *(v.alias(k) for k, v in languages.advice(F.col("language")).items()))


def primary(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of three made-up strategies, of which the first gives none for short texts."""
    d = _docs(spark, sf)
    some = closed.fixed_size(d.filter(F.length("text") > 2000), 1500).withColumn("strategy", F.lit("long"))
    more = closed.fixed_size(d.filter(F.length("text") > 500), 700).withColumn("strategy", F.lit("middle"))
    rest = closed.fixed_size(d, 300).withColumn("strategy", F.lit("short"))
    return feedback.first_success(some.unionByName(more).unionByName(rest), ["long", "middle", "short"])


def sums_of_levels(spark: SparkSession, sf: str) -> DataFrame:
    return fixed(spark, sf).select("doc_id", "chunk_index", profiles.level_fingerprint(F.col("content"), [F.col("size"), F.col("chunk_index") * 256]).alias("fingerprint"))


QUERIES = {
    "q_language_detect": detected,
    "q_language_scores": lambda s, sf: languages.scores(_docs(s, sf)).drop("_text"),
    "q_language_advice": advised,
    "q_feedback_weighted": lambda s, sf: feedback.weighted_feedback(signals(s, sf)),
    "q_throughput": lambda s, sf: feedback.throughput(runs(s, sf), "source"),
    "q_progress": progressed,
    "q_best_strategies": lambda s, sf: feedback.best(measured(s, sf), "file"),
    "q_first_success": primary,
    "q_chunk_profiles": lambda s, sf: profiles.chunk_profiles(fixed(s, sf)),
    "q_level_fingerprint": sums_of_levels,
    "q_chunk_estimates": estimates,
    "q_cut_quality": lambda s, sf: profiles.cut_quality(fixed(s, sf), 480, 500, size="size"),
    "q_level_quality": lambda s, sf: profiles.level_quality(fixed(s, sf).withColumn("digest", F.md5(F.encode("content", "UTF-8"))), 480, 500, size="size"),
    "q_tttd_divisors": divisors,
    "q_topic_labels": lambda s, sf: topics.topic_labels(_sentences(s, sf)),
    "q_topic_weights": lambda s, sf: topics.topic_weights(labels(s, sf)),
    "q_topic_coherence": lambda s, sf: topics.topic_coherence(_sentences(s, sf), labels(s, sf)),
    "q_topic_keywords": lambda s, sf: topics.topic_keywords(_sentences(s, sf), labels(s, sf)),
    "q_topic_breaks": lambda s, sf: topics.topic_breaks(labels(s, sf), topics.topic_coherence(_sentences(s, sf), labels(s, sf))),
    "q_similarity_breaks": lambda s, sf: topics.similarity_breaks(_sentences(s, sf)),
    "q_confident_breaks": lambda s, sf: topics.confident(topics.similarity_breaks(_sentences(s, sf)), 0.29),
    "q_entity_sentences": found,
    "q_entity_breaks": lambda s, sf: topics.entity_breaks(found(s, sf), spaced(s, sf)),
    "q_context_scores": lambda s, sf: topics.context_scores(with_sentences(s, sf), 150, 400),
    "q_fingerprint_terms": lambda s, sf: topics.fingerprint(fixed(s, sf), 50),
}

_FIXED = _char_sql(500, 0, True)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _score_sql(lang: str) -> str:
    share = f"len(list_filter(w, lambda x: list_contains({_LIST(languages.COMMON[lang])}, x))) / len(w)"
    if lang in languages.UNSPACED:
        marks = "(" + " + ".join(f"length(h) - length(replace(h, '{m}', ''))" for m in languages.MARKS[lang]) + ")"
    else:
        marks = f"len(list_filter(w, lambda x: list_contains({_LIST(languages.MARKS[lang])}, x)))"
    return f"round(CASE WHEN len(w) > 0 THEN 0.7 * ({share}) + 0.3 * least(1.0, {marks} / length(h) * 1000) ELSE 0 END, 6) AS \"{lang}\""


_WORDS = r"[\p{L}\p{N}_]+"
_SCORES = f"(SELECT doc_id, text, {', '.join(map(_score_sql, languages.COMMON))} FROM (SELECT doc_id, text, lower(substring(coalesce(text, ''), 1, 1000)) AS h, regexp_extract_all(lower(substring(coalesce(text, ''), 1, 1000)), '{_WORDS}') AS w FROM documents))"
_RANKED = f"""(SELECT doc_id, lang, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, place) AS r FROM (
SELECT doc_id, unnest({_LIST(languages.COMMON)}) AS lang, unnest([{', '.join(f'"{x}"' for x in languages.COMMON)}]) AS s, unnest(range(0, 10)) AS place FROM {_SCORES} WHERE regexp_matches(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]')) WHERE s > 0)"""
_SCRIPT_COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '[{a}-{z}]')) AS {k}" for k, (a, z, _) in languages.SCRIPTS.items())
_SCRIPT_SUM = " + ".join(languages.SCRIPTS)
_SCRIPT_LIST = "list_filter([" + ", ".join(f"CASE WHEN ({_SCRIPT_SUM}) > 0 AND {k} >= 0.05 * ({_SCRIPT_SUM}) THEN '{k}' END" for k in languages.SCRIPTS) + "], lambda x: x IS NOT NULL)"
_BY_SCRIPT = "CASE l[1] " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in languages.SCRIPTS.items()) + " END"
_DETECT = f"""WITH sc AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]') AS filled, {_SCRIPT_LIST} AS l FROM (SELECT doc_id, text, {_SCRIPT_COUNTS} FROM documents)),
b AS (SELECT doc_id, max(CASE WHEN r = 1 THEN lang END) AS lang, max(CASE WHEN r = 1 THEN s END) AS s, string_agg(lang, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM {_RANKED} GROUP BY doc_id)
SELECT doc_id, coalesce(lang, CASE WHEN filled THEN {_BY_SCRIPT} END, 'unknown') AS language, coalesce(s, CASE WHEN filled AND {_BY_SCRIPT} IS NOT NULL THEN 0.3 ELSE 0 END) AS confidence, CASE WHEN filled THEN array_to_string(l, ',') ELSE '' END AS scripts, coalesce(top, '') AS top FROM sc LEFT JOIN b USING (doc_id)"""
_ADVICE = ", ".join("CASE " + " ".join(f"WHEN language IN ({', '.join(repr(x) for x in row[0])}) THEN '{row[j]}'" for row in languages.ADVICE.values() if row[0]) + f" ELSE '{languages.ADVICE['other'][j]}' END AS {name}" for j, name in enumerate(("by_sentence", "by_word", "by_character"), 1))
_EST = "SELECT doc_id, '{rule}' AS rule, CASE WHEN n <= {least} THEN 1 ELSE greatest(1, e - v) END AS fewest, CASE WHEN n <= {least} THEN 1 ELSE e + v END AS most FROM (SELECT doc_id, n, e, greatest(1, CAST(floor(e * {share}) AS BIGINT)) AS v FROM (SELECT doc_id, octet_length(encode(text)) AS n, greatest(1, CAST(floor(octet_length(encode(text)) / {size}) AS BIGINT)) AS e FROM documents))"
_LABELS = f"(SELECT doc_id, i, CAST(length(sentence) % 3 AS INT) AS topic FROM {_S})"
_GROUPED = rf"""e AS (SELECT s.doc_id, topic, s.i, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {_S} s JOIN {_LABELS} l ON s.doc_id = l.doc_id AND s.i = l.i),
tf AS (SELECT doc_id, topic, i, term, count(*) AS tf FROM e GROUP BY ALL), d AS (SELECT doc_id, topic, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT doc_id, topic, count(*) AS n FROM {_LABELS} GROUP BY ALL),
w AS (SELECT doc_id, topic, i, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (doc_id, topic, term) JOIN n USING (doc_id, topic)), u AS (SELECT doc_id, topic, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, topic, i)) AS weight FROM w),
a AS (SELECT doc_id, topic, sum(s * s) AS whole FROM (SELECT doc_id, topic, term, sum(weight) AS s FROM u GROUP BY ALL) GROUP BY ALL), f AS (SELECT doc_id, topic, count(DISTINCT i) AS filled FROM u GROUP BY ALL),
c AS (SELECT doc_id, topic, n, round(CASE WHEN n < 2 THEN 1.0 ELSE (coalesce(whole, 0) - coalesce(filled, 0)) / (n * (n - 1)) END, 6) + 0.0 AS coherence FROM n LEFT JOIN a USING (doc_id, topic) LEFT JOIN f USING (doc_id, topic))"""
_BREAKS = f"""{_TF}, m AS (SELECT a.doc_id AS doc_id, a.i AS i, round(sum(a.weight * b.weight), 6) AS sim FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i + 1 = b.i GROUP BY a.doc_id, a.i),
p AS (SELECT doc_id, i, coalesce(sim, 0) AS sim FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS k FROM {_S}) LEFT JOIN m USING (doc_id, i) WHERE k >= 3 AND i < k - 1)
SELECT doc_id, i + 1 AS position, 'semantic_break' AS kind, round((1 - sim) * 0.3, 9) AS confidence FROM p WHERE sim < 0.7"""
_SPACED = rf"(SELECT doc_id, i, regexp_replace(sentence, '[ \t\n\v\f\r]+', ' ', 'g') AS sentence FROM {_S})"
_FOUND = rf"""s AS (SELECT doc_id, i, start, start + length(sentence) AS stop FROM (SELECT doc_id, i, sentence, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {_SPACED})),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS word, unnest(range(0, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')))) AS p FROM (SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS text FROM {_SPACED} GROUP BY doc_id)),
e AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(word, '{v}') THEN '{k}'" for k, v in ENTITIES.items())} END AS label, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(word) AS n FROM t),
x AS (SELECT s.doc_id, s.i, e.start, e.start + e.n AS stop, e.label FROM s JOIN e ON s.doc_id = e.doc_id AND e.label IS NOT NULL AND e.start >= s.start AND e.start + e.n <= s.stop)"""
_CHUNKS4 = f"(SELECT doc_id, i // 4 AS chunk_index, string_agg(sentence, ' ' ORDER BY i) AS content, count(*) AS sentences FROM {_S} GROUP BY ALL)"

ORACLE_SQL = {
    "q_language_scores": f"SELECT * EXCLUDE (text) FROM {_SCORES}",
    "q_language_detect": _DETECT,
    "q_language_advice": f"SELECT doc_id, {_ADVICE} FROM ({_DETECT})",
    "q_feedback_weighted": """WITH s AS (SELECT user_id AS strategy, event_id AS "at", value / 100 AS score, CAST(1 + event_id % 3 AS DOUBLE) AS weight, event_type AS kind FROM events),
w AS (SELECT strategy, "at", sum(score * weight) OVER l / sum(weight) OVER l AS m, list(kind) OVER l AS kinds, count(*) OVER (PARTITION BY strategy ORDER BY "at") AS seen FROM s WINDOW l AS (PARTITION BY strategy ORDER BY "at" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
k AS (SELECT strategy, "at", kind, count(*) AS n FROM (SELECT strategy, "at", unnest(kinds) AS kind FROM w) GROUP BY ALL),
b AS (SELECT strategy, "at", kind, row_number() OVER (PARTITION BY strategy, "at" ORDER BY n DESC, kind) AS r FROM k)
SELECT w.strategy, w."at", round(m, 9) AS mean_score, kind AS main_kind, seen >= 3 AND round(m, 9) < 0.5 AS adapt FROM w JOIN b ON w.strategy = b.strategy AND w."at" = b."at" AND r = 1""",
    "q_throughput": "SELECT source, count(*) AS files, CAST(sum(c) AS BIGINT) AS chunks, round(count(*) / sum(s), 6) AS files_per_second, round(sum(c) / sum(s), 6) AS chunks_per_second, round(sum(b) / 1048576 / sum(s), 6) AS mb_per_second FROM (SELECT source, CAST(floor(length(coalesce(text, '')) / 1000 + 1) AS BIGINT) AS c, octet_length(encode(coalesce(text, ''))) AS b, (doc_id % 7 + 1) / 8 AS s FROM documents) GROUP BY source",
    "q_progress": "SELECT p_partkey, round(d / t, 6) AS share, round(r, 6) AS mb_per_second, CASE WHEN r > 0 THEN round((t - d) / 1048576 / r, 6) END AS eta_seconds FROM (SELECT p_partkey, d, t, CASE WHEN s > 0 THEN d / 1048576 / s ELSE 0 END AS r FROM (SELECT p_partkey, p_partkey * 1000 AS d, p_partkey * 1000 + p_size * 50000 AS t, p_size % 9 AS s FROM part))",
    "q_best_strategies": """WITH m AS (SELECT p_brand AS strategy, p_size % 5 AS file, count(*) AS sec, sum(p_size) AS mb, max(p_size) AS mem, CASE WHEN min(p_size) > 8 THEN avg(p_size) END AS q FROM part GROUP BY ALL)
SELECT CAST(file AS BIGINT) AS file, first(strategy ORDER BY sec, strategy) AS fastest, first(strategy ORDER BY mb DESC, strategy) AS highest_throughput, first(strategy ORDER BY mem, strategy) AS lowest_memory, first(strategy ORDER BY q DESC NULLS LAST, strategy) AS highest_quality FROM m GROUP BY file""",
    "q_first_success": f"""WITH a AS (SELECT *, 'long' AS strategy, 1 AS r FROM ({_char_sql(1500, 0)}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 2000) UNION ALL SELECT *, 'middle', 2 FROM ({_char_sql(700, 0)}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 500) UNION ALL SELECT *, 'short', 3 FROM ({_char_sql(300, 0)})),
n AS (SELECT doc_id, strategy, r, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT doc_id, min(r) AS r, string_agg(strategy || ':' || n, ',' ORDER BY strategy || ':' || n) AS counts FROM n GROUP BY doc_id)
SELECT a.doc_id, chunk_index, content, size, strategy, counts FROM a JOIN t ON a.doc_id = t.doc_id AND a.r = t.r""",
    "q_chunk_profiles": rf"""WITH c AS ({_FIXED}), b AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM c), k AS (SELECT doc_id, chunk_index, b, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT doc_id, chunk_index, sum(n) AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM k GROUP BY ALL)
SELECT doc_id, chunk_index, octet_length(encode(content)) AS n_bytes, round(h, 6) AS entropy, round(CASE WHEN h > 1e-12 THEN 1 - h / 8 ELSE 1 END, 6) AS compressibility, len(regexp_extract_all(content, '[^\p{{Cc}}\p{{Cf}}\p{{Co}}]|[ \t\n\v\f\r]')) > 0.8 * length(content) AS is_text, md5(content) AS md5, sha256(content) AS sha256, substring(md5(content), 1, 16) AS fingerprint FROM c JOIN t USING (doc_id, chunk_index)""",
    "q_level_fingerprint": f"SELECT doc_id, chunk_index, substring(sha256(encode(content) || unhex(lpad(hex(xor(size, chunk_index * 256)), 16, '0'))), 1, 16) AS fingerprint FROM ({_FIXED})",
    "q_chunk_estimates": " UNION ALL ".join(_EST.format(rule=r, least=le, share=sh, size=repr(size)) for r, le, sh, size in (("buzhash", 2048, 0.25, 8192.0), ("tttd", 2048, 0.4, 2048.0), ("ml_cdc", 1024, 0.35, 8192.0))),
    "q_cut_quality": f"SELECT doc_id, count(*) AS chunks, round(greatest(0, 1 - abs(1 - avg(size) / 480)), 6) AS size_score, round(avg(CASE WHEN size < 500 THEN 1.0 ELSE 0.0 END), 6) AS cut_ratio, round(0.4 * greatest(0, 1 - abs(1 - avg(size) / 480)) + 0.3 * avg(CASE WHEN size < 500 THEN 1.0 ELSE 0.0 END) + 0.3 * 0.9, 6) AS quality FROM ({_FIXED}) GROUP BY doc_id",
    "q_level_quality": f"SELECT doc_id, count(*) AS chunks, round(0.3 * greatest(0, 1 - abs(1 - avg(size) / 480)) + 0.25 * avg(CASE WHEN size < 500 THEN 1.0 ELSE 0.0 END) + 0.2 + 0.25 * count(DISTINCT md5(content)) / count(*), 6) AS quality FROM ({_FIXED}) GROUP BY doc_id",
    "q_tttd_divisors": f"""WITH m AS (SELECT doc_id, avg(size) AS mean, count(*) AS n, 1024 + doc_id * 40 AS p, 4096 + doc_id * 160 AS s FROM ({_FIXED}) GROUP BY doc_id), o AS (SELECT *, n >= 3 AND abs(mean - 380) > 76 AS off FROM m)
SELECT doc_id, CAST(CASE WHEN off AND mean > 380 THEN greatest(512, floor(p * 0.9)) WHEN off THEN least(4096, floor(p * 1.1)) ELSE p END AS BIGINT) AS "primary", CAST(CASE WHEN off AND mean > 380 THEN greatest(1024, floor(s * 0.9)) WHEN off THEN least(16384, floor(s * 1.1)) ELSE s END AS BIGINT) AS secondary FROM o""",
    "q_topic_weights": f"SELECT doc_id, topic, count(*) AS sentences, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS weight FROM {_LABELS} GROUP BY doc_id, topic",
    "q_topic_coherence": f"WITH {_GROUPED} SELECT doc_id, topic, n, coherence FROM c",
    "q_topic_breaks": f"WITH {_GROUPED}, v AS (SELECT doc_id, i, topic, lead(topic) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM {_LABELS}) SELECT v.doc_id, v.i + 1 AS position, 'topic_shift' AS kind, round((x.coherence + y.coherence) / 2 * 0.4, 9) AS confidence FROM v JOIN c x ON v.doc_id = x.doc_id AND v.topic = x.topic JOIN c y ON v.doc_id = y.doc_id AND v.nxt = y.topic WHERE v.topic <> v.nxt",
    "q_topic_keywords": f"{_TF}, l AS (SELECT * FROM {_LABELS}), k AS (SELECT doc_id, topic, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT u.doc_id, l.topic, term, round(sum(weight) / any_value(k.n), 9) AS mean FROM u JOIN l ON u.doc_id = l.doc_id AND u.i = l.i JOIN k ON l.doc_id = k.doc_id AND l.topic = k.topic GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY mean DESC, term) AS place FROM m) SELECT doc_id, topic, place, term, round(mean, 6) AS mean FROM r WHERE place <= 5 AND mean > 0.1",
    "q_similarity_breaks": _BREAKS,
    "q_confident_breaks": f"SELECT * FROM ({_BREAKS}) WHERE confidence >= 0.29",
    "q_entity_sentences": f"WITH {_FOUND} SELECT doc_id, i, start, stop, label FROM x",
    "q_entity_breaks": f"""WITH {_FOUND}, l AS (SELECT doc_id, i, list_distinct(list(label)) AS ls FROM x GROUP BY ALL), o AS (SELECT s.doc_id, s.i, coalesce(ls, []) AS ls FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.i = l.i), p AS (SELECT doc_id, i, ls, lead(ls) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM o),
q AS (SELECT doc_id, i, len(list_intersect(ls, nx)) / len(list_distinct(list_concat(ls, nx))) AS a FROM p WHERE nx IS NOT NULL AND (len(ls) > 0 OR len(nx) > 0)) SELECT doc_id, i + 1 AS position, 'entity_boundary' AS kind, round((1 - a) * 0.3, 9) AS confidence FROM q WHERE a < 0.5""",
    "q_context_scores": f"SELECT doc_id, chunk_index, CASE WHEN sentences <= 1 OR length(content) - sentences + 1 >= 400 THEN 1.0 WHEN length(content) - sentences + 1 >= 150 THEN 0.8 ELSE 0.6 END::DOUBLE AS context, (CASE WHEN regexp_matches(content, '[.!?:;][ \\t\\n\\v\\f\\r]*$') THEN 1.0 ELSE 0.5 END + 1.0)::DOUBLE / 2 AS closing FROM {_CHUNKS4}",
    "q_fingerprint_terms": rf"""WITH n AS (SELECT doc_id, chunk_index, term, count(*) AS n FROM (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM ({_FIXED})) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY n DESC, term) AS place FROM n)
SELECT doc_id, chunk_index, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_index)), 6) AS weight FROM r WHERE place <= 50""",
}
