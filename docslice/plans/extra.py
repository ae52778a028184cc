"""Queries on plug-in chunkers and office blocks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.operators import office, plugins
from docslice.runtime import table

#: Words of the test tables, which hold none of the default lists.
FOR, AGAINST = ["the", "der", "les", "los"], ["of", "und", "et", "que"]


def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of documents as blocks; one of under 40 characters counts as a heading of level 1."""
    line = F.posexplode(F.split(T.filled(F.col("text")), "\n"))
    own = table(spark, sf, "documents").select("doc_id", line.alias("block_index", "line")).withColumn("text", T.strip(F.col("line"))).filter("text <> ''")
    short = F.length("text") < 40
    return own.select("doc_id", F.col("block_index").cast("long").alias("block_index"), F.when(short, "heading").otherwise("paragraph").alias("kind"), short.cast("int").alias("level"), "text")


QUERIES = {
    "q_pattern_sections": lambda spark, sf: plugins.pattern_sections(table(spark, sf, "documents")),
    "q_sentiment_groups": lambda spark, sf: plugins.sentiment_groups(table(spark, sf, "documents"), 0.05, 2, FOR, AGAINST),
    "q_balanced_length": lambda spark, sf: plugins.balanced_length(table(spark, sf, "documents")),
    "q_balanced_greedy": lambda spark, sf: plugins.balanced_length(table(spark, sf, "documents"), method="greedy"),
    "q_doc_paragraphs": lambda spark, sf: office.by_paragraphs(line_blocks(spark, sf)),
    "q_doc_headings": lambda spark, sf: office.by_headings(line_blocks(spark, sf)),
    "q_doc_size": lambda spark, sf: office.by_size(line_blocks(spark, sf)),
}

_BLOCKS = r"""
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS block_index FROM documents),
b AS (SELECT doc_id, block_index, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM l),
k AS (SELECT * FROM b WHERE text <> '')"""
_GATHERED = """
c AS (SELECT doc_id, g, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS content FROM s GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chunk_index, content, length(content) AS size FROM c WHERE length(content) >= 50"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SCORE = rf"""CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda x: list_contains({_list(FOR)}, x))) - len(list_filter(w, lambda x: list_contains({_list(AGAINST)}, x)))) / len(w) ELSE 0 END"""

ORACLE_SQL = {
    "q_doc_paragraphs": f"WITH {_BLOCKS}, s AS (SELECT doc_id, block_index, text, (row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1) // 5 AS g FROM k), {_GATHERED}",
    "q_doc_headings": f"WITH {_BLOCKS}, s AS (SELECT doc_id, block_index, text, sum(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index) AS g FROM k), {_GATHERED}",
    "q_sentiment_groups": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM d),
e AS (SELECT doc_id, unnest(parts) AS s, unnest(range(0, len(parts))) AS pos FROM p WHERE len(parts) > 2),
w AS (SELECT doc_id, s, pos, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+') AS w FROM e),
v AS (SELECT doc_id, s, pos, {_SCORE} AS v FROM w),
g AS (SELECT doc_id, CASE WHEN v > 0.05 THEN 0 WHEN v < -0.05 THEN 1 ELSE 2 END AS g, string_agg(s, ' ' ORDER BY pos) AS content FROM v GROUP BY ALL),
whole AS (SELECT doc_id, 0 AS g, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM p WHERE len(parts) <= 2),
c AS (SELECT * FROM g UNION ALL SELECT * FROM whole WHERE content <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chunk_index, content, length(content) AS size FROM c""",
}
