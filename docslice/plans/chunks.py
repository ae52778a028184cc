"""Queries on chunk tables and content profiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions import analyze
from docslice.functions import text as T
from docslice.operators import cdc, chunkops, closed, pack
from docslice.plans.splits import LINED, SPACE, STRIP, WORDS, _char_sql, blank_lined
from docslice.operators.kernel import spread
from docslice.runtime import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return closed.fixed_size(_docs(spark, sf), 500)


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    c = closed.fixed_size(_docs(spark, sf), 500, 50)
    return c.withColumn("start", F.greatest(F.col("chunk_index") * 500 - 50, F.lit(0)))


def _on(change):
    return lambda spark, sf: change(_chunks(spark, sf))


def _text(change, name: str = "clean"):
    return lambda spark, sf: _docs(spark, sf).select("doc_id", change(T.filled(F.col("text"))).alias(name))


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return chunkops.quality(_chunks(spark, sf), _docs(spark, sf))


def _cdc(rule, **settings):
    return lambda spark, sf: cdc.content_defined(_docs(spark, sf), rule, **settings).select("doc_id", "chunk_index", "start", "n_bytes", "digest")


def _strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents by several strategies."""
    docs = _docs(spark, sf)
    made = {"fixed": closed.fixed_size(docs, 500), "words": closed.word_windows(docs, 100, 20), "universal": closed.universal_fixed(docs)}
    out = None
    for name, c in made.items():
        c = c.withColumn("strategy", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _strategies(spark, sf).groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg("size"), 4).alias("mean_size"), F.round(F.median("size"), 4).alias("median_size"), F.min("size").alias("least"), F.max("size").alias("most"), F.round(F.stddev_samp("size"), 4).alias("std_size"))


def strategy_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies of each source by the evenness of their sizes."""
    from pyspark.sql.window import Window

    by = _strategies(spark, sf).join(_docs(spark, sf).select("doc_id", "source"), "doc_id").groupBy("source", "strategy").agg(F.round(chunkops.size_consistency(F.col("size")), 6).alias("score"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "strategy")).cast("long"))


def feedback_window(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the last ten feedback values of each user, and whether to tune (under .4 with three signals or more)."""
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("value") / 100).alias("score"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    out = e.withColumns({"recent": F.round(F.avg("score").over(w), 6), "signals": F.count("*").over(w)})
    return out.select("user_id", "event_id", "recent", "signals", ((F.col("recent") < 0.4) & (F.col("signals") >= 3)).alias("tune"))


#: First bytes of kinds of content, dealt to documents in turn.
HEADS = ("", "89504E470D0A1A0A", "FFD8FFE0", "494433", "4F676753", "1A45DFA3", "255044462D", "504B0304", "FEFF00", "474946383961")


def modality_counts(spark: SparkSession, sf: str) -> DataFrame:
    head = F.unhex(F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int")))
    return _docs(spark, sf).groupBy(analyze.modality(F.concat(head, F.encode("text", "UTF-8"))).alias("modality")).agg(F.count("*").alias("n"))


def repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of which some stand twice or three times."""
    c = _chunks(spark, sf)
    return chunkops.repeated_ids(c.unionByName(c.filter("chunk_index % 3 = 1")).unionByName(c.filter("doc_id % 5 = 0")))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the first of their document as their parent, which some documents have lost."""
    c = _chunks(spark, sf).select("doc_id", F.col("chunk_index").cast("string").alias("path"), F.when(F.col("chunk_index") > 0, "0").alias("parent_path"))
    return chunkops.missing_parents(c.filter("doc_id % 3 <> 0 OR path <> '0'"))


def selection(spark: SparkSession, sf: str) -> DataFrame:
    """Strategy by the ending of a made-up file name of each part."""
    p = table(spark, sf, "part")
    names = list(analyze.BY_EXTENSION)
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p_partkey") % len(names) + 1).cast("int")))
    files = p.select("p_partkey", path.alias("path"), (F.col("p_size") * 400_000).cast("long").alias("length"))
    return analyze.select_strategy(files).select("p_partkey", "extension", "strategy")


QUERIES = {
    "q_chunk_stats": _on(chunkops.result_stats),
    "q_filter": _on(lambda c: chunkops.keep_sizes(c, 100, 450)),
    "q_transform": _on(lambda c: chunkops.transform(c, lambda x: F.when(F.length(x) > 200, F.lower(x)))),
    "q_remove_empty": _on(chunkops.remove_empty),
    "q_enrich": _on(chunkops.enrich),
    "q_merge_short": lambda s, sf: chunkops.merge_short(closed.exploded(_docs(s, sf), T.sentences(T.filled(F.col("text")))), 60, 200),
    "q_dedup_jaccard": lambda s, sf: chunkops.drop_similar(closed.exploded(_docs(s, sf), T.sentences(T.filled(F.col("text"))))),
    "q_dedup_equal": lambda s, sf: chunkops.drop_equal(closed.exploded(_docs(s, sf), T.sentences(T.filled(F.col("text"))))),
    "q_normalise": _on(lambda c: chunkops.transform(c, T.normal_spaces)),
    "q_quality": _quality,
    "q_recommendations": lambda s, sf: chunkops.recommendations(_quality(s, sf)),
    "q_overlap": lambda s, sf: chunkops.overlap_ratio(closed.fixed_size(_docs(s, sf), 2000, 100)),
    "q_validate_spans": lambda s, sf: chunkops.span_issues(_spans(s, sf)),
    "q_validate_chunks": _on(lambda c: chunkops.chunk_issues(c, 100, 499)),
    "q_validate_ids": repeated,
    "q_validate_parent": orphans,
    "q_modality_counts": modality_counts,
    "q_preprocess_ws": _text(T.normal_spaces),
    "q_headers_footers": _text(T.without_frames),
    "q_clean_markup": lambda s, sf: table(s, sf, "pages").select("page_id", T.without_markup(T.filled(F.col("html"))).alias("clean")),
    "q_normalise_quotes": _text(T.plain_quotes),
    "q_structure_class": lambda s, sf: analyze.profile(blank_lined(s, sf)),
    "q_complexity": lambda s, sf: analyze.complexity(_docs(s, sf)),
    "q_entropy": lambda s, sf: analyze.entropy(_docs(s, sf)),
    "q_language": lambda s, sf: analyze.language(_docs(s, sf)),
    "q_scripts": lambda s, sf: _docs(s, sf).select("doc_id", *(v.alias(k) for k, v in analyze.scripts(F.col("text")).items())),
    "q_auto_select": lambda s, sf: analyze.auto_select(_docs(s, sf)),
    "q_select_extension": selection,
    "q_strategy_compare": strategy_summary,
    "q_strategy_rank": strategy_rank,
    "q_multi_strategy": lambda s, sf: _strategies(s, sf).groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks")),
    "q_feedback_window": feedback_window,
    "q_fastcdc": _cdc(cdc.fastcdc),
    "q_fastcdc_small": _cdc(cdc.fastcdc, least=256, avg=1024, most=4096, bits=10),
    "q_fastcdc_rabin": _cdc(cdc.fastcdc_rolling),
    "q_fastcdc_buzhash": _cdc(cdc.fastcdc_rolling, kind="buzhash"),
    "q_rolling_poly": _cdc(cdc.rolling_polynomial),
    "q_rolling_rabin": _cdc(cdc.rolling_rabin, least=256, target=4096, most=4096),
    "q_rolling_buzhash": _cdc(cdc.buzhash, least=256, most=4096, every=512),
    "q_rabin": _cdc(cdc.rabin),
    "q_buzhash": _cdc(cdc.buzhash),
    "q_gear": _cdc(cdc.gear_cdc),
    "q_mlcdc": _cdc(cdc.ml_cdc),
    "q_tttd": _cdc(cdc.tttd),
    "q_univ_rolling": _cdc(cdc.universal_rolling),
}

C = f"({_char_sql(500, 0)})"
SENT = f"""(WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)({SPACE}+|$)', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') AS u FROM documents)
SELECT doc_id, unnest(range(0, len(u))) AS chunk_index, unnest(u) AS content FROM d)"""
NORMAL = "regexp_replace(regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\\1', 'g')"


def _normal(c: str) -> str:
    return STRIP.format(c=NORMAL.format(c=c))


_CHARS = "list_distinct(regexp_extract_all(lower({c}), '[^ \t\n\v\f\r]'))"
_QUALITY = f"""WITH c AS (SELECT doc_id, chunk_index, size, {STRIP.format(c='content')} AS c FROM {C}),
n AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nx FROM c),
w AS (SELECT *, regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM n),
s AS (SELECT doc_id, size, least(1.0, (CASE WHEN regexp_matches(c, '[.!?]$') THEN 0.3 ELSE 0 END) + 0.2 + (CASE WHEN regexp_matches(c, '[.!?]') THEN 0.2 ELSE 0 END) + (CASE WHEN regexp_matches(lower(c), 'and|but|however|therefore|thus|also') THEN 0.1 ELSE 0 END) + (CASE WHEN length(c) - length(replace(c, chr(10), '')) < length(c) / 50 THEN 0.2 ELSE 0 END))::DOUBLE AS co,
CASE WHEN length(c) = 0 THEN 0 ELSE 0.4 * len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]')) / length(c) + 0.4 * (CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END) + 0.2 * least(1.0, length(c) / 50) END::DOUBLE AS de,
greatest(0, 1.0 - (CASE WHEN length(c) = 0 THEN 0.5 ELSE 0 END) - (CASE WHEN length(c) < 5 THEN 0.3 ELSE 0 END) - (CASE WHEN length(c) > 10000 THEN 0.2 ELSE 0 END))::DOUBLE AS va,
CASE WHEN nx IS NOT NULL THEN least(1.0, greatest(0.0, (CASE WHEN regexp_matches(c, '[.!?]$') THEN 0.4 ELSE 0 END) + (CASE WHEN regexp_matches(nx, '^\\p{{Lu}}') THEN 0.3 ELSE 0 END) - (CASE WHEN ends_with(c, '-') THEN 0.2 ELSE 0 END) - (CASE WHEN (length(c) - length(replace(c, '"', ''))) % 2 = 1 THEN 0.1 ELSE 0 END))) END::DOUBLE AS se,
CASE WHEN length(c) < 5 THEN 1 ELSE 0 END AS empty, {_CHARS.format(c='c')} AS chars FROM w),
b AS (SELECT doc_id, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(stddev_samp(size) / avg(size), 0) / 0.5) END AS size_consistency, avg(co) AS coherence, avg(de) AS density, avg(va) AS validation, coalesce(avg(se), 1.0) AS boundary, avg(empty) AS empty_ratio, list_distinct(flatten(list(chars))) AS chars FROM s GROUP BY doc_id),
f AS (SELECT b.*, CASE WHEN len({_CHARS.format(c='d.text')}) > 0 THEN len(list_intersect(chars, {_CHARS.format(c='d.text')})) / len({_CHARS.format(c='d.text')}) ELSE 1.0 END AS coverage FROM b JOIN documents d USING (doc_id)),
o AS (SELECT *, greatest(0.0, 0.15 * size_consistency + 0.25 * coherence + 0.2 * coverage + 0.2 * boundary + 0.15 * density + 0.05 * validation - CASE WHEN empty_ratio > 0.1 THEN 0.5 * empty_ratio ELSE 0 END) AS overall FROM f)
SELECT doc_id, round(size_consistency, 6) AS size_consistency, round(coherence, 6) AS coherence, round(coverage, 6) AS coverage, round(boundary, 6) AS boundary, round(density, 6) AS density, round(validation, 6) AS validation, round(empty_ratio, 6) AS empty_ratio, round(overall, 6) AS overall FROM o"""

_LANG = ", ".join(
    f"round(0.7 * (CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in analyze.COMMON[lang])}))) / len(w) ELSE 0 END) + 0.3 * (CASE WHEN length(h) > 0 THEN least(1.0, 1000 * len(regexp_extract_all(h, '{analyze.MARKS[lang]}')) / length(h) / 100) ELSE 0 END), 6) AS {lang}" for lang in analyze.COMMON
)
def _union() -> str:
    from docslice.plans.splits import ORACLE_SQL as O

    return " UNION ALL ".join(f"SELECT '{name}' AS strategy, doc_id, size FROM ({sql})" for name, sql in (("fixed", _char_sql(500, 0)), ("words", O["q_word_windows"]), ("universal", O["q_univ_fixed"])))


_RECOMMEND = f"""SELECT doc_id, concat_ws(',', CASE WHEN size_consistency < 0.7 THEN 'even_sizes' END, CASE WHEN coherence < 0.6 THEN 'keep_sentences' END, CASE WHEN boundary < 0.6 THEN 'better_boundaries' END, CASE WHEN density < 0.5 THEN 'drop_filler' END, CASE WHEN empty_ratio > 0.1 THEN 'drop_empty' END) AS advice FROM ({_QUALITY})"""
_EXT = "[" + ", ".join(repr(x) for x in analyze.BY_EXTENSION) + "]"
_STRAT = "[" + ", ".join(repr(x) for x in analyze.BY_EXTENSION.values()) + "]"

ORACLE_SQL = {
    "q_chunk_stats": f"SELECT doc_id, count(*) AS chunks, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size, min(size) AS least, max(size) AS most FROM {C} GROUP BY doc_id",
    "q_filter": f"SELECT * FROM {C} WHERE size BETWEEN 100 AND 450",
    "q_transform": f"SELECT doc_id, chunk_index, CASE WHEN length(content) > 200 THEN lower(content) ELSE content END AS content, CAST(length(CASE WHEN length(content) > 200 THEN lower(content) ELSE content END) AS BIGINT) AS size FROM {C}",
    "q_remove_empty": f"SELECT * FROM {C} WHERE regexp_matches(content, '[^ \t\n\v\f\r]')",
    "q_enrich": f"""SELECT doc_id, chunk_index, content, size, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(len({WORDS.format(c='content')}) AS BIGINT) AS word_count,
CAST(len(list_filter(string_split(content, '.'), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]'))) AS BIGINT) AS sentence_count,
round(CASE WHEN len({WORDS.format(c='content')}) > 0 THEN length(regexp_replace(content, '{SPACE}', '', 'g')) / len({WORDS.format(c='content')}) ELSE 0 END, 6) AS avg_word_length,
round(length(replace(content, ' ', '')) / length(content), 6) AS density, length({STRIP.format(c='content')}) > 10 AS meaningful FROM {C}""",
    "q_dedup_equal": f"WITH s AS (SELECT sha256(content) AS digest, min(struct_pack(doc_id := doc_id, chunk_index := chunk_index)) AS f FROM {SENT} GROUP BY 1) SELECT f.doc_id AS doc_id, f.chunk_index AS chunk_index, digest FROM s",
    "q_normalise": f"SELECT doc_id, chunk_index, {_normal('content')} AS content, CAST(length({_normal('content')}) AS BIGINT) AS size FROM {C}",
    "q_quality": _QUALITY,
    "q_recommendations": _RECOMMEND,
    "q_validate_spans": f"""WITH s AS (SELECT doc_id, chunk_index, size, greatest(chunk_index * 500 - 50, 0) AS start FROM ({_char_sql(500, 50)})),
w AS (SELECT doc_id, chunk_index, lead(start) OVER (PARTITION BY doc_id ORDER BY chunk_index) - (start + size) AS gap, lag(start) OVER (PARTITION BY doc_id ORDER BY chunk_index) > start AS disordered FROM s)
SELECT * FROM w WHERE gap <> 0 OR disordered""",
    "q_validate_chunks": f"SELECT * FROM (SELECT doc_id, chunk_index, concat_ws(',', CASE WHEN NOT regexp_matches(content, '[^ \t\n\v\f\r]') THEN 'empty' END, CASE WHEN length(content) < 100 THEN 'short' END, CASE WHEN length(content) > 499 THEN 'long' END) AS issues FROM {C}) WHERE issues <> ''",
    "q_validate_ids": f"SELECT doc_id, chunk_index, 1 + CAST(chunk_index % 3 = 1 AS BIGINT) + CAST(doc_id % 5 = 0 AS BIGINT) AS times FROM {C} WHERE chunk_index % 3 = 1 OR doc_id % 5 = 0",
    "q_validate_parent": f"SELECT doc_id, CAST(chunk_index AS VARCHAR) AS path, '0' AS parent_path FROM {C} WHERE doc_id % 3 = 0 AND chunk_index > 0",
    "q_modality_counts": "SELECT ['text', 'image', 'image', 'audio', 'audio', 'video', 'mixed', 'mixed', 'mixed', 'image'][doc_id % 10 + 1] AS modality, count(*) AS n FROM documents GROUP BY 1",
    "q_preprocess_ws": f"SELECT doc_id, {_normal('text')} AS clean FROM documents",
    "q_headers_footers": f"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT ((i <= 5 OR i > len(string_split(text, chr(10))) - 5) AND length({STRIP.format(c='x')}) < 20 AND regexp_matches(lower(x), 'page|chapter|copyright|confidential|draft|footer|header'))), chr(10)) AS clean FROM documents""",
    "q_clean_markup": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#{1,6}[ \t]+', '', 'g'), '[*_~`]+', '', 'g') AS clean FROM pages",
    "q_normalise_quotes": """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[‘’‚‛]', '''', 'g'), '[“”„‟]', '"', 'g'), '[‐-―]', '-', 'g'), '[   -   　]', ' ', 'g') AS clean FROM documents""",
    "q_structure_class": rf"""WITH s AS (SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '\n{SPACE}*\n', chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]'))) AS BIGINT) AS paragraphs,
CAST(len(list_filter(string_split(regexp_replace(text, '[.!?]+', chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]'))) AS BIGINT) AS sentences,
CAST(len(regexp_extract_all(text, '(?m)^#+\s+')) + len(regexp_extract_all(text, '(?m)^[A-Z][A-Z\s]+$')) + len(regexp_extract_all(text, '(?m)^\d+\.\s+')) AS BIGINT) AS headings,
CAST(len(regexp_extract_all(text, '(?m)^[ \t]*[-*+][ \t]+')) + len(regexp_extract_all(text, '(?m)^[ \t]*\d+\.[ \t]+')) AS BIGINT) AS lists,
CAST(len(regexp_extract_all(text, '```[\s\S]*?```')) AS BIGINT) AS code FROM {LINED})
SELECT *, CASE WHEN code > 0 THEN 'technical_document' WHEN headings > paragraphs * 0.1 THEN 'structured_document' WHEN lists > paragraphs * 0.2 THEN 'list_heavy' WHEN paragraphs > 10 AND headings < 3 THEN 'narrative' ELSE 'mixed' END AS structure_type FROM s""",
    "q_complexity": rf"""WITH c AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w, list_filter(string_split(regexp_replace(text, '[.!?]+', chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS s FROM documents),
m AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) / len(w) AS d, length(array_to_string(w, '')) / len(w) AS l, CASE WHEN len(s) > 0 THEN len({WORDS.format(c="array_to_string(s, ' ')")}) / len(s) ELSE 0 END AS p, len(regexp_extract_all(text, '[.,;:!?]')) / length(text) AS q FROM c),
t AS (SELECT *, CASE WHEN n > 0 THEN round(least(l / 10, 1.0) * 0.3 + least(p / 30, 1.0) * 0.3 + d * 0.2 + least(q * 100, 1.0) * 0.2, 6) ELSE 0.0 END AS score FROM m)
SELECT doc_id, score, CASE WHEN n > 0 THEN round(d, 6) END AS diversity, CASE WHEN n > 0 THEN round(l, 6) END AS word_length, CASE WHEN n = 0 THEN 'unknown' WHEN score < 0.3 THEN 'simple' WHEN score < 0.6 THEN 'moderate' ELSE 'complex' END AS readability FROM t""",
    "q_entropy": """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS total, sum(n * log2(n)) AS x, count(*) AS distinct_bytes FROM c GROUP BY doc_id)
SELECT doc_id, round(log2(total) - x / total, 6) AS entropy, distinct_bytes FROM s""",
    "q_language": f"""WITH h AS (SELECT doc_id, lower(substring(text, 1, 1000)) AS h FROM documents), w AS (SELECT doc_id, h, regexp_extract_all(h, '[\\p{{L}}\\p{{N}}_]+') AS w FROM h), s AS (SELECT doc_id, {_LANG} FROM w)
SELECT *, CASE greatest({', '.join(analyze.COMMON)}) {' '.join(f"WHEN {x} THEN '{x}'" for x in analyze.COMMON)} END AS language FROM s""",
    "q_scripts": "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{v}')) AS BIGINT) AS {k}" for k, v in {"latin": r"[\x20-\x{24F}]", "cyrillic": r"[\x{400}-\x{4FF}]", "arabic": r"[\x{600}-\x{6FF}]", "cjk": r"[\x{4E00}-\x{9FFF}]", "hiragana": r"[\x{3040}-\x{309F}]", "katakana": r"[\x{30A0}-\x{30FF}]", "hangul": r"[\x{AC00}-\x{D7AF}]"}.items()) + " FROM documents",
    "q_auto_select": r"""WITH m AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS h, len(regexp_extract_all(text, '(?m)^#{1,6} ')) + len(regexp_extract_all(text, '(?m)^[-*+] ')) + len(regexp_extract_all(text, '\n\n')) AS marks FROM documents),
s AS (SELECT *, least(1.0, CASE WHEN n > 0 THEN marks / (n / 1000) ELSE 0 END) AS shape FROM m)
SELECT doc_id, round(shape, 6) AS structure, CASE WHEN regexp_matches(text, '^\s*[\[{]') AND json_valid(text) THEN 'json' WHEN regexp_matches(text, '(?i)^\s*(<!doctype|<html|<\?xml)') THEN 'markup' WHEN h >= 2 THEN 'markdown' WHEN n > 100000 THEN 'fastcdc' WHEN shape > 0.5 THEN 'paragraph_based' ELSE 'sentence_based' END AS strategy FROM s""",
    "q_select_extension": f"""WITH f AS (SELECT p_partkey, {_EXT}[p_partkey % {len(analyze.BY_EXTENSION)} + 1] AS extension, {_STRAT}[p_partkey % {len(analyze.BY_EXTENSION)} + 1] AS st, p_size * 400000 AS n FROM part)
SELECT p_partkey, extension, CASE WHEN n > {analyze.LARGE} THEN 'fastcdc' ELSE st END AS strategy FROM f""",
    "q_strategy_compare": f"SELECT strategy, count(*) AS chunks, count(DISTINCT doc_id) AS documents, round(avg(size), 4) AS mean_size, round(median(size), 4) AS median_size, min(size) AS least, max(size) AS most, round(stddev_samp(size), 4) AS std_size FROM ({_union()}) GROUP BY strategy",
    "q_strategy_rank": f"""WITH s AS (SELECT source, strategy, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(stddev_samp(size) / avg(size), 0) / 0.5) END, 6) AS score FROM ({_union()}) JOIN documents USING (doc_id) GROUP BY source, strategy)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, strategy) AS place FROM s""",
    "q_multi_strategy": f"SELECT doc_id, strategy, count(*) AS chunks FROM ({_union()}) GROUP BY ALL",
    "q_feedback_window": """WITH e AS (SELECT user_id, event_id, round(avg(value / 100) OVER w, 6) AS recent, count(*) OVER w AS signals FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT *, recent < 0.4 AND signals >= 3 AS tune FROM e""",
}
