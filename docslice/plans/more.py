"""Queries on the catalogue, pipelines, streams and media, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from docslice.functions import analyze
from docslice.operators import markup, media, semantic, structured
from docslice.operators.kernel import chunk_rows, spread
from docslice.plans import catalog
from docslice.plans.documents import _S, nested_json
from docslice.plans.splits import images
from docslice.runtime import scratch, table
from docslice.streaming import chunks as streams


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.run(table(spark, sf, "documents"), {"before": ["spaces", "quotes"], "strategy": "sentence_based", "after": [{"step": "filter", "least": 100, "most": 2000}]})


def sql_chunks(spark: SparkSession, sf: str) -> DataFrame:
    catalog.register_sql(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT d.doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.content FROM _documents d, LATERAL fixed_chunks(coalesce(d.text, ''), 700) c")


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in pieces of 256 characters, chunked as a stream and read back from its sink."""
    base = scratch(spark, "stream")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("t"))
    n = F.greatest(F.ceil(F.length("t") / 256), F.lit(1)).cast("int")
    pieces = docs.select("source", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    pieces.select("source", F.col("seq").cast("long").alias("seq"), F.substring("t", F.col("seq") * 256 + 1, F.lit(256)).alias("text"), (F.col("seq") == F.col("n") - 1).alias("last")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("source string, seq long, text string, last boolean").parquet(f"{base}/in")
    out = streams.chunk_stream(stream, streams.fixed(1000))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.OUTPUT).parquet(f"{base}/out").select(F.col("source").cast("long").alias("doc_id"), "chunk_index", "offset", "content")


def silence(spark: SparkSession, sf: str) -> DataFrame:
    """Sounding stretches of a made-up level track of each part."""
    p = table(spark, sf, "part")
    level = F.transform(F.sequence(F.lit(0), F.col("p_size") * 10), lambda i: F.when((i % 37) < 9, -60.0).otherwise(-20.0))
    tracks = p.select(F.col("p_partkey").alias("media_id"), level.alias("levels"))
    fold = partial(semantic.silence_segments, step=0.1, below=-40.0, quiet=0.5, pad=0.1, shortest=1.0, longest=2.0)
    return chunk_rows(tracks, fold, ["levels"], "start double, stop double", "media_id").select("media_id", F.col("chunk_index").alias("segment"), "start", "stop")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of made-up media, one a second: histograms from events, a medium for each user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), (place - 1).cast("double").alias("t"), "event_id", "value")
    bins = [F.col("value"), (F.col("event_id") % 7).cast("double"), (F.col("event_id") % 11).cast("double"), 100 - F.col("value")]
    return e.select("media_id", "t", F.array(*bins).alias("hist"))


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return media.scene_segments(media.histogram_changes(f), f.groupBy("media_id").agg((F.count("*") + 0.5).alias("duration")), 30.0, 3.0, 4.0)


def structures(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of small made-up frames of 8 by 8 grey levels."""
    f = frames(spark, sf)
    grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * F.floor(F.col("hist")[0]) + F.col("hist")[1] * 31) % 256).cast("double"))
    return media.structure_changes(f.select("media_id", "t", grey.alias("grey")), 8)


def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return structured.json_arrays(nested_json(spark, sf), 10, rebuild=True)


def fronted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which two thirds begin with front matter."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    head = F.concat(F.lit("---\ntitle: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\nno value:\nkind: a\nkind: b\n---\n"))
    return markup.frontmatter(d.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(head, "t")).otherwise(F.col("t")).alias("text")))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Encodings of documents with marks of several kinds before them, or none."""
    marks = F.array(*(F.unhex(F.lit(h)) for h in ("", "EFBBBF", "FFFE", "FEFF", "0000FEFF")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.concat(F.element_at(marks, (F.col("doc_id") % 5 + 1).cast("int")), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return analyze.detect_encoding(d, 1 << 30)


def pair_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = semantic.sentence_table(spread(table(spark, sf, "documents")))
    return semantic.tfidf(s, pairs=True, most=40, stop=("the", "of", "and", "der", "die", "de", "la", "que")).select("doc_id", "i", "term", F.round("weight", 6).alias("weight"))


QUERIES = {
    "q_catalogue": lambda s, sf: catalog.catalogue(s),
    "q_recommend": lambda s, sf: catalog.recommended(s),
    "q_pipeline": pipeline,
    "q_pipeline_multi": lambda s, sf: catalog.multi(table(s, sf, "documents"), ["fixed_size", "sentence_based", "fastcdc"]).groupBy("strategy").agg(F.count("*").alias("chunks")),
    "q_sql_udtf": sql_chunks,
    "q_stream_chunks": streamed,
    "q_silence_segments": silence,
    "q_scene_changes": lambda s, sf: media.histogram_changes(frames(s, sf)),
    "q_scene_segments": scenes,
    "q_scene_structure": structures,
    "q_edge_patches": lambda s, sf: media.edge_patches(images(s, sf), 64, 24),
    "q_json_rebuilt": rebuilt,
    "q_frontmatter": fronted,
    "q_encodings": encoded,
    "q_tfidf_pairs": pair_weights,
}

_HIST = "[value, CAST(event_id % 7 AS DOUBLE), CAST(event_id % 11 AS DOUBLE), 100 - value]"
_FRAMES = f"(SELECT user_id AS media_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) AS t, {_HIST} AS h FROM events)"
_SPREAD = "(list_dot_product(h, h) - list_sum(h) * list_sum(h) / 4) * (list_dot_product(p, p) - list_sum(p) * list_sum(p) / 4)"
_CHANGES = f"(SELECT media_id, t, round((1 - CASE WHEN {_SPREAD} > 1e-12 THEN (list_dot_product(h, p) - list_sum(h) * list_sum(p) / 4) / sqrt({_SPREAD}) ELSE 1.0 END) * 100, 6) AS difference FROM (SELECT media_id, t, h, lag(h) OVER (PARTITION BY media_id ORDER BY t) AS p FROM {_FRAMES}) WHERE p IS NOT NULL)"
_SCENES = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT media_id, list(t ORDER BY t) AS ts FROM {_CHANGES} WHERE difference > 30 GROUP BY media_id), m AS (SELECT user_id AS media_id, count(*) + 0.5 AS duration FROM events GROUP BY user_id),
r AS (SELECT media_id, CAST(0 AS BIGINT) AS k, ts[1] AS t FROM x UNION ALL SELECT media_id, k + 1, n FROM (SELECT r.media_id, k, list_filter(ts, lambda v: v - r.t >= 3)[1] AS n FROM r JOIN x USING (media_id)) WHERE n IS NOT NULL),
b AS (SELECT media_id, t, coalesce(lag(t) OVER (PARTITION BY media_id ORDER BY t), 0) AS a FROM r), s AS (SELECT media_id, a, t, greatest(1, CAST(ceil((t - a) / 4) AS BIGINT)) AS n FROM b),
e AS (SELECT media_id, a + (t - a) * k / n AS start, a + (t - a) * (k + 1) / n AS stop FROM (SELECT *, unnest(range(0, n)) AS k FROM s) UNION ALL SELECT m.media_id, coalesce(z, 0), duration FROM m LEFT JOIN (SELECT media_id, max(t) AS z FROM r GROUP BY media_id) USING (media_id) WHERE coalesce(z, 0) < duration)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start) - 1 AS segment, round(start, 6)::DOUBLE AS start, round(stop, 6)::DOUBLE AS stop FROM e"""
_IMAGE = "(SELECT p_partkey AS image_id, p_size * 13 + 7 AS w, p_size * 7 + 64 AS h FROM part)"
_STOP = "['the', 'of', 'and', 'der', 'die', 'de', 'la', 'que']"
_WORDS2 = rf"list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))"

ORACLE_SQL = {
    "q_scene_changes": f"SELECT * FROM {_CHANGES}",
    "q_scene_segments": _SCENES,
    "q_edge_patches": f"""WITH i AS (SELECT image_id, w, h, greatest(0, w - 64) AS mx, greatest(0, h - 64) AS my FROM {_IMAGE}), p AS (SELECT image_id, unnest([0, mx, 0, mx]) AS x, unnest([0, 0, my, my]) AS y FROM i
UNION ALL SELECT image_id, x, unnest([0, my]) FROM (SELECT image_id, my, unnest(range(0, w - 63, 48)) AS x FROM i) UNION ALL SELECT image_id, unnest([0, mx]), y FROM (SELECT image_id, mx, unnest(range(0, h - 63, 48)) AS y FROM i)
UNION ALL SELECT image_id, w // 2 - 32, h // 2 - 32 FROM i WHERE w // 2 >= 32 AND h // 2 >= 32) SELECT DISTINCT image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM p""",
    "q_json_rebuilt": """SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, 'more.inner.tags' AS path, CAST(0 AS BIGINT) AS first FROM (SELECT p_partkey, '{"more":{"inner":{"tags":["' || p_type || '","' || p_brand || '","x"]}}}' AS c FROM part)
UNION ALL SELECT p_partkey, s // 10 + 1, c, CAST(length(c) AS BIGINT), 'nums', s FROM (SELECT p_partkey, s, '{"nums":[' || array_to_string(range(s, least(s + 10, p_size + 1)), ',') || ']}' AS c FROM (SELECT p_partkey, p_size, unnest(range(0, p_size + 1, 10)) AS s FROM part))""",
    "q_frontmatter": """SELECT doc_id, CASE WHEN f THEN 'title: "Doc ' || doc_id || '"' || chr(10) || 'no value:' || chr(10) || 'kind: a' || chr(10) || 'kind: b' END AS raw, CASE WHEN f THEN '{"kind":"b","title":"Doc ' || doc_id || '"}' END AS fields, coalesce(text, '') AS body FROM (SELECT *, doc_id % 3 > 0 AS f FROM documents)""",
    "q_encodings": "SELECT doc_id AS path, CASE WHEN k = 0 AND coalesce(text, '') = '' THEN 'utf-8' ELSE ['utf-8', 'utf-8-sig', 'utf-16-le', 'utf-16-be', 'utf-32-be'][k + 1] END AS encoding, CASE WHEN k > 0 OR coalesce(text, '') = '' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN k > 0 THEN 'mark' WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'trial' END AS method FROM (SELECT *, doc_id % 5 AS k FROM documents)",
    "q_tfidf_pairs": rf"""WITH s AS (SELECT doc_id, i, {_WORDS2} AS w FROM {_S}), e AS (SELECT doc_id, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM s), n AS (SELECT doc_id, count(*) AS n FROM {_S} GROUP BY doc_id),
tf AS (SELECT doc_id, i, term, count(*) AS tf FROM e GROUP BY ALL), a AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY sum(tf) DESC, term) AS place, count(*) AS df FROM tf GROUP BY doc_id, term),
w AS (SELECT tf.doc_id, i, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN a USING (doc_id, term) JOIN n USING (doc_id) WHERE place <= 40) SELECT doc_id, i, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, i)), 6) AS weight FROM w""",
    "q_sql_udtf": "WITH e AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM documents) SELECT doc_id, k AS chunk_index, substring(text, k * 700 + 1, 700) AS content FROM e",
    "q_stream_chunks": "WITH e AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS k FROM documents) SELECT doc_id, k AS chunk_index, k * 1000 AS \"offset\", substring(text, k * 1000 + 1, 1000) AS content FROM e",
}
