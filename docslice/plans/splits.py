"""Queries of the chunkers and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.operators import closed, pack
from docslice.operators.kernel import spread
from docslice.runtime import table

CH = "doc_id, chunk_index, content, size"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def blank_lined(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text: documents with each line a paragraph."""
    return _docs(spark, sf).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence packs of all documents, then their quality by source."""
    docs = _docs(spark, sf)
    chunks = pack.sentence_based(docs, 5, 1, 0, 2000).join(docs.select("doc_id", "source"), "doc_id")
    ends = F.col("content").rlike(r"[.!?]\z").cast("double")
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("size"), 4).alias("mean_size"), F.round(F.stddev_pop("size"), 4).alias("std_size"), F.round(F.avg(ends), 6).alias("closed_share"))


#: Ways to write what both engines compute on the same text.
SPACE = r"[ \t\n\v\f\r]"
WORDS = r"regexp_extract_all({c}, '[^ \t\n\v\f\r]+')"
STRIP = r"regexp_replace(regexp_replace({c}, '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', '')"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{c}}, '([.!?]+)({SPACE}+|$)', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')"
AFTER_STOP = rf"list_filter(list_transform(string_split(regexp_replace({{c}}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')"
PARAGRAPHS = rf"list_transform(list_filter(list_transform(string_split(regexp_replace({STRIP.format(c='{c}')}, '\r?\n{SPACE}*\r?\n', chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> ''), lambda x: regexp_replace(x, '{SPACE}+', ' ', 'g'))"
BLOCKS = rf"list_filter(list_transform(string_split(regexp_replace({{c}}, '\n{SPACE}*\n', chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')"
LINED = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


def _char_sql(size: int, overlap: int, trim: bool = False) -> str:
    piece = f"substring(text, greatest(k * {size} - {overlap}, 0) + 1, least(k * {size} + {size}, n) - greatest(k * {size} - {overlap}, 0))"
    content = "p"
    if trim:
        back = "length(p) - strpos(reverse(p), ' ')"
        content = f"CASE WHEN k * {size} + {size} < n AND NOT regexp_matches(substring(text, k * {size} + {size} + 1, 1), '{SPACE}') AND strpos(p, ' ') > 0 AND {back} > 0.8 * length(p) THEN substring(p, 1, {back}) ELSE p END"
    return f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
e AS (SELECT doc_id, text, n, unnest(range(0, CAST(ceil(n / {size}.0) AS BIGINT))) AS k FROM d),
f AS (SELECT doc_id, k, n, text, {piece} AS p FROM e),
g AS (SELECT doc_id, k, {content} AS content FROM f)
SELECT doc_id, k AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM g"""


def _list_sql(units: str, expr: str, starts: str, source: str = "documents", where: str = "true") -> str:
    """Chunks from a list u of units with n entries; starts: SQL for the list of starts; expr in s (0-based)."""
    return f"""WITH d AS (SELECT doc_id, text, {units} AS u FROM {source}),
c AS (SELECT doc_id, text, u, len(u) AS n FROM d),
e AS (SELECT doc_id, text, u, n, list_filter({starts}, lambda s: {where}) AS ss FROM c),
f AS (SELECT doc_id, text, u, n, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM e),
g AS (SELECT doc_id, k, {expr} AS content FROM f)
SELECT doc_id, k AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM g"""


def joined_sql(units: str, sep: str, limit: int, source: str = "documents", extra: int = 0, most: int | None = None, count_sep: bool = True, group_key: str = "doc_id") -> str:
    """Greedy packing by a recursive walk over the units. count_sep: whether separators count in the length so far."""
    gap = f"+ length({sep})" if count_sep else ""
    full = f"r.len + length(u.u[r.i + 1]) + {extra} > {limit}" + (f" OR r.cnt >= {most}" if most else "")
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT {group_key}, {units} AS u FROM {source}),
r AS (SELECT {group_key}, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(length(u[1]) AS BIGINT) AS len, CAST(1 AS BIGINT) AS cnt FROM u WHERE len(u) > 0
UNION ALL
SELECT r.{group_key}, r.i + 1, CASE WHEN {full} THEN r.g + 1 ELSE r.g END,
CASE WHEN {full} THEN length(u.u[r.i + 1]) ELSE r.len + length(u.u[r.i + 1]) {gap} END,
CASE WHEN {full} THEN 1 ELSE r.cnt + 1 END
FROM r JOIN u USING ({group_key}) WHERE r.i < len(u.u)),
j AS (SELECT r.{group_key}, r.g, string_agg(u.u[r.i], {sep} ORDER BY r.i) AS content FROM r JOIN u USING ({group_key}) GROUP BY ALL)
SELECT {group_key}, g AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM j"""


W = WORDS.format(c="text")
RANGE = "range(0, n, {step})"
JOIN_WORDS = "array_to_string(list_slice(u, s + 1, s + {w}), ' ')"


def _cut(x: str, most: int) -> str:
    head = f"substring({x}, 1, {most})"
    at = f"strpos(reverse({head}), ' ')"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN {at} > 0 AND {most} - {at} > 0 THEN substring({head}, 1, {most} - {at}) ELSE {head} END"


FALLBACK = f"""(SELECT doc_id, text, CASE WHEN len(f) = 0 OR (len(f) = 1 AND length(text) > 1000) THEN
CASE WHEN len(l) > 5 AND len(list_filter(l, lambda x: len({WORDS.format(c='x')}) <= 2)) > 0.7 * len(l) THEN l
WHEN contains(text, chr(10) || chr(10)) THEN list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')
WHEN length(text) > 2000 THEN list_filter(list_transform(range(0, length(text), 500), lambda s: {STRIP.format(c='substring(text, s + 1, 500)')}), lambda x: x <> '')
ELSE f END ELSE f END AS uu
FROM (SELECT doc_id, text, {SENTENCES.format(c='text')} AS f, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') AS l FROM documents))"""

_PACKED = joined_sql("uu", "' '", 2000, FALLBACK, most=5, count_sep=False)

_DOCS = lambda f: lambda spark, sf: f(_docs(spark, sf))
_LINES = lambda f: lambda spark, sf: f(blank_lined(spark, sf))


def sentence_rows(df: DataFrame) -> DataFrame:
    from docslice.functions import text as T

    return closed.exploded(df, T.sentences(T.filled(F.col("text"))))


def paragraph_rows(df: DataFrame) -> DataFrame:
    from docslice.functions import text as T

    return closed.exploded(df, T.paragraphs(T.filled(F.col("text"))))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Image sizes from the parts table."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 13 + 7).cast("int").alias("width"), (F.col("p_size") * 7 + 64).cast("int").alias("height"))


def media(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("media_id"), (F.col("p_size") * 4321).cast("long").alias("duration_ms"))


QUERIES = {
    "q_flagship": flagship,
    "q_fixed_char": _DOCS(lambda d: closed.fixed_size(d, 1000)),
    "q_fixed_char_overlap": _DOCS(lambda d: closed.fixed_size(d, 500, 50)),
    "q_fixed_boundary": _DOCS(lambda d: closed.fixed_size(d, 500, 0, preserve_boundaries=True)),
    "q_fixed_word": _DOCS(lambda d: closed.fixed_size(d, 100, 10, unit="word")),
    "q_fixed_byte": _DOCS(lambda d: closed.fixed_size(d, 512, 16, unit="byte")),
    "q_fixed_binary": _DOCS(lambda d: closed.fixed_size_binary(d, 700, "text").select("doc_id", "chunk_index", F.md5("content_bin").alias("digest"), "offset", "length")),
    "q_univ_fixed": _DOCS(lambda d: closed.universal_fixed(d)),
    "q_univ_overlap_char": _DOCS(lambda d: closed.universal_window(d)),
    "q_univ_overlap_word": _DOCS(lambda d: closed.universal_window(d, 150, 30, unit="word")),
    "q_word_windows": _DOCS(lambda d: closed.word_windows(d, 100, 20)),
    "q_overlap_window_words": _DOCS(lambda d: closed.overlapping_window(d, 100, 50, min_window=10)),
    "q_overlap_window_sentences": _DOCS(lambda d: closed.overlapping_window(d, 6, 3, unit="sentence", max_chars=600)),
    "q_overlap_window_chars": _DOCS(lambda d: pack.character_windows(d, 1000, 500, 50)),
    "q_token_simple": _DOCS(lambda d: closed.token_windows(d, 200, 20, 10, 900)),
    "q_sentences": _DOCS(sentence_rows),
    "q_sentence_pack": _DOCS(lambda d: pack.sentence_based(d, 5, 1, 0, 10**9)),
    "q_sentence_pack_capped": _DOCS(lambda d: pack.sentence_based(d)),
    "q_sentence_pack_overlap": _DOCS(lambda d: pack.sentence_based(d, 5, 2, 1, 1500)),
    "q_paragraph_split": _LINES(paragraph_rows),
    "q_paragraph_merge_short": _LINES(lambda d: pack.paragraph_units(d, 80)),
    "q_paragraph_pack": _LINES(lambda d: pack.paragraph_based(d, 3, 0, 1200, 0)),
    "q_paragraph_pack_merged": _LINES(lambda d: pack.paragraph_based(d, 3, 1, 1200, 80)),
    "q_univ_sentence": _DOCS(lambda d: pack.universal_sentence(d)),
    "q_univ_paragraph": _LINES(lambda d: pack.universal_paragraph(d)),
    "q_structured_pack": _LINES(lambda d: pack.universal_document(d, 1000, 0)),
    "q_text_window_lastspace": _DOCS(lambda d: pack.text_windows(d, 1000, 100)),
    "q_recursive": _LINES(lambda d: pack.recursive(d)),
    "q_recursive_stats": _LINES(lambda d: pack.recursive_stats(pack.recursive(d))),
    "q_image_grid": lambda s, sf: closed.image_grid(images(s, sf), 128, 96, 16),
    "q_image_patches": lambda s, sf: closed.image_patches(images(s, sf), 64, 48, "skip"),
    "q_image_patches_random": lambda s, sf: closed.random_patches(images(s, sf), 32, 4),
    "q_time_segments": lambda s, sf: closed.time_segments(media(s, sf), 30, 5, 2),
    "q_video_segments": lambda s, sf: closed.time_segments(media(s, sf), 60, 0, 1),
}

_GRID = """WITH i AS (SELECT p_partkey AS image_id, p_size * 13 + 7 AS width, p_size * 7 + 64 AS height FROM part),
r AS (SELECT image_id, width, height, unnest(range(0, height, {dy})) AS y FROM i),
t AS (SELECT image_id, width, height, y, unnest(range(0, width, {dx})) AS x FROM r)
SELECT image_id, CAST(y // {dy} AS BIGINT) AS row, CAST(x // {dx} AS BIGINT) AS col, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(least(width - x, {w}) AS BIGINT) AS w, CAST(least(height - y, {h}) AS BIGINT) AS h FROM t"""

_TIME = """WITH m AS (SELECT p_partkey AS media_id, CAST(p_size * 4321 AS BIGINT) AS n FROM part),
s AS (SELECT media_id, n, unnest(range(0, n, {step})) AS start FROM m)
SELECT media_id, start // {step} AS segment, start, least(start + {size}, n) AS "end" FROM s
WHERE (least(start + {size}, n) - start >= {shortest} OR start = 0) AND (start = 0 OR start - {step} + {size} < n)"""

ORACLE_SQL = {
    "q_flagship": f"""SELECT source, count(*) AS chunks, round(avg(size), 4) AS mean_size, round(stddev_pop(size), 4) AS std_size, round(avg(CASE WHEN regexp_matches(content, '[.!?]$') THEN 1.0 ELSE 0.0 END), 6) AS closed_share
FROM ({_PACKED}) c JOIN documents USING (doc_id) GROUP BY source""",
    "q_fixed_char": _char_sql(1000, 0),
    "q_fixed_char_overlap": _char_sql(500, 50),
    "q_fixed_boundary": _char_sql(500, 0, True),
    "q_fixed_word": _list_sql(W, "array_to_string(list_slice(u, greatest(s - 10, 0) + 1, s + 100), ' ')", RANGE.format(step=100)),
    "q_fixed_binary": """WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
e AS (SELECT doc_id, h, n, unnest(range(0, n, 700)) AS s FROM d)
SELECT doc_id, s // 700 AS chunk_index, md5(unhex(substring(h, 2 * s + 1, 1400))) AS digest, s AS "offset", CAST(least(n - s, 700) AS BIGINT) AS length FROM e""",
    "q_univ_fixed": _list_sql("[text]", "substring(text, s + 1, 1000)", "range(0, length(text), 1000)"),
    "q_univ_overlap_char": _list_sql("[text]", "CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, s + 1, 1000) END", "CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 800) END"),
    "q_univ_overlap_word": _list_sql(W, "CASE WHEN n <= 150 THEN text ELSE array_to_string(list_slice(u, s + 1, s + 150), ' ') END", "CASE WHEN n <= 150 THEN [0] ELSE range(0, n, 120) END"),
    "q_word_windows": _list_sql(W, JOIN_WORDS.format(w=100), RANGE.format(step=80), where="s = 0 OR s - 80 + 100 < n"),
    "q_overlap_window_words": _list_sql(W, _cut(JOIN_WORDS.format(w=100), 8000), RANGE.format(step=50), where="s = 0 OR least(s + 100, n) - s >= 10"),
    "q_overlap_window_sentences": _list_sql(SENTENCES.format(c="text"), _cut(JOIN_WORDS.format(w=6), 600), RANGE.format(step=3), where="s = 0 OR least(s + 6, n) - s >= 1"),
    "q_token_simple": _list_sql(W, _cut("array_to_string(list_slice(u, CAST(floor(s / n * n) AS BIGINT) + 1, CAST(floor(least(s + 200, n) / n * n) AS BIGINT)), ' ')", 900), RANGE.format(step=180), where="(s = 0 OR s - 180 + 200 < n) AND (least(s + 200, n) - s >= 10 OR s + 200 >= n)"),
    "q_sentences": _list_sql(SENTENCES.format(c="text"), "u[s + 1]", RANGE.format(step=1)),
    "q_sentence_pack": joined_sql("uu", "' '", 10**9, FALLBACK, most=5, count_sep=False),
    "q_sentence_pack_capped": _PACKED,
    "q_paragraph_split": _list_sql(PARAGRAPHS.format(c="text"), "u[s + 1]", RANGE.format(step=1), LINED),
    "q_paragraph_pack": joined_sql(PARAGRAPHS.format(c="text"), "chr(10) || chr(10)", 1200, LINED, most=3, count_sep=False),
    "q_univ_sentence": joined_sql(AFTER_STOP.format(c="text"), "' '", 1000),
    "q_univ_paragraph": joined_sql(BLOCKS.format(c="text"), "chr(10) || chr(10)", 2000, LINED),
    "q_structured_pack": joined_sql(BLOCKS.format(c="text"), "chr(10) || chr(10)", 1000, LINED, extra=2),
    "q_image_grid": _GRID.format(dx=112, dy=80, w=128, h=96),
    "q_image_patches": f"SELECT * FROM ({_GRID.format(dx=48, dy=48, w=64, h=64)}) WHERE w = 64 AND h = 64",
    "q_time_segments": _TIME.format(step=25000, size=30000, shortest=2000),
    "q_video_segments": _TIME.format(step=60000, size=60000, shortest=1000),
}
ORACLE_SQL["q_paragraph_merge_short"] = f"""WITH p AS (SELECT doc_id, {PARAGRAPHS.format(c='text')} AS u FROM {LINED}),
e AS (SELECT doc_id, unnest(u) AS t, unnest(range(0, len(u))) AS i FROM p),
g AS (SELECT doc_id, t, i, sum(CASE WHEN i = 0 OR length(t) >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e)
SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, string_agg(t, chr(10) || chr(10) ORDER BY i) AS content, CAST(length(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS BIGINT) AS size FROM g GROUP BY doc_id, k"""
