"""Queries on discourse, the chunk model, XML, code outlines, tokens, PDF, byte windows, sinks and event-time streams,
and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.functions import tokens
from docslice.operators import closed, discourse, markup, model, pdf, semantic, windows
from docslice.plans import catalog
from docslice.plans.documents import _CUT, _S, _docs, _sentences, _sims, code_text
from docslice.plans.splits import SPACE, STRIP, _char_sql
from docslice.runtime import materialise, scratch, table
from docslice.sources import files
from docslice.streaming import chunks as streams

CODE = "# head\\nimport os  # no quote\\ns = 'a # b'\\ndef f{k}(x):\\n    return {s} # n\\nclass A{k}:\\n    pass\\n"
SLASHES = "// head {k}\\nfunc f(x int) {{ // {s}\\n  y := 1 /* a\\n b */ + {s}\\n}}\\ntype T struct {{}}\\n"


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents, every few with a phrase put in front or behind."""
    s = _sentences(spark, sf)
    p = (F.col("doc_id") + F.col("i")) % 11
    text = F.when(p == 3, F.concat(F.lit("However, "), "sentence")).when(p == 5, F.concat(F.lit("In summary, "), "sentence")).when(p == 8, F.concat("sentence", F.lit(" so then also"))).otherwise(F.col("sentence"))
    return s.withColumn("sentence", text)


def shifts(spark: SparkSession, sf: str) -> DataFrame:
    return discourse.topic_shift(marked(spark, sf), 10**9)


def cuts(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.by_threshold(_sims(spark, sf)).select("doc_id", "i", F.round("sim", 6).alias("sim"))


def _breaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences and their markers, as tables that all steps read, and the boundaries."""
    own = materialise(marked(spark, sf), "marked")
    found = materialise(discourse.markers(own), "markers")
    return own, found, discourse.boundaries(own, cuts(spark, sf), discourse.topic_shift(own, 10**9), least=0.45, own_markers=found)


def breaks(spark: SparkSession, sf: str) -> DataFrame:
    return _breaks(spark, sf)[2]


def discourse_chunks(spark: SparkSession, sf: str) -> DataFrame:
    own, found, cut = _breaks(spark, sf)
    return discourse.chunks(own, cut, found)


def modelled(spark: SparkSession, sf: str) -> DataFrame:
    own = closed.fixed_size(_docs(spark, sf), 900)
    parent = F.when(F.col("chunk_index") > 0, model.chunk_id(F.col("doc_id"), F.lit(0)))
    odd = F.when(F.col("chunk_index") % 2 == 1, F.col("chunk_index"))
    kind = F.when(F.col("content").contains("|"), "table").otherwise("text")
    return model.modelled(own, "fixed_size", kind, parent, {"position": odd})


def order_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as an XML document."""
    o = table(spark, sf, "orders")
    item = F.concat(F.lit('<order status="'), "o_orderstatus", F.lit('"><id>'), F.col("o_orderkey").cast("string"), F.lit("</id><p>"), "o_orderpriority", F.lit("</p>&amp;</order>"))
    by = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))), lambda r: r["x"]), "").alias("b"))
    return by.select("page_id", F.concat(F.lit('<?xml version="1.0"?><all>'), "b", F.lit("</all>")).alias("html"))


def part_pdf(spark: SparkSession, sf: str) -> DataFrame:
    """A PDF of two pages for each part."""
    p = table(spark, sf, "part")
    head = "%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type /Pages /Kids [5 0 R 3 0 R] /Count 2>>\nendobj\n3 0 obj\n<</Type /Page /Parent 2 0 R /Contents 4 0 R>>\nendobj\n5 0 obj\n<</Type /Page /Parent 2 0 R /Contents 6 0 R>>\nendobj\n"
    stream = lambda n, x: F.concat(F.lit(f"{n} 0 obj\n<</Length 9>>\nstream\nBT /F1 12 Tf 72 700 Td ("), x, F.lit(") Tj 0 -14 Td [(size) -300 (is )] TJ ("), F.col("p_size").cast("string"), F.lit(") Tj ET\nendstream\nendobj\n"))
    return p.select(F.col("p_partkey").alias("path"), F.concat(F.lit(head), stream(4, F.col("p_name")), stream(6, F.col("p_type")), F.lit("trailer\n<</Root 1 0 R>>\n%%EOF\n")).cast("binary").alias("content"))


def bytes_of(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("path"), F.encode(T.filled(F.col("text")), "UTF-8").alias("content"))


def dumped(form: str):
    """Chunks written in a form and read back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = closed.fixed_size(_docs(spark, sf), 800).withColumn("content", F.replace(F.col("content"), F.lit("\\"), F.lit("/")))
        path = scratch(spark, f"dump-{form}")
        files.write_chunks(own, path, form)
        if form == "csv":
            raise ValueError("a CSV dump has no header to read it by")
        if form == "yaml":
            value = F.from_json(F.substring("value", 3, 2**31 - 4), own.schema)
            return spark.read.text(path).select(value.alias("v")).select("v.*")
        return spark.read.schema(own.schema).format(form).load(path)

    return run


def event_stream(which: str):
    """Events as a stream into a sink that appends, read back: what the watermark has let go."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        base = scratch(spark, f"events-{which}")
        table(spark, sf, "events").coalesce(1).write.parquet(f"{base}/in")
        stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{base}/in")
        made = {"tumbling": streams.windowed_counts, "sliding": streams.sliding_counts, "distinct": streams.distinct_events}[which](stream)
        made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(made.schema).parquet(f"{base}/out")
        return out.select("event_id") if which == "distinct" else out.select(F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n")

    return run


def resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of pieces that is stopped half way and started again from its checkpoint."""
    base = scratch(spark, "resumed")
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("source"), T.filled(F.col("text")).alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    first = docs.select("source", F.lit(0).cast("long").alias("seq"), F.col("t").substr(F.lit(1), half).alias("text"), F.lit(False).alias("last"))
    second = docs.select("source", F.lit(1).cast("long").alias("seq"), F.col("t").substr(half + 1, F.length("t")).alias("text"), F.lit(True).alias("last"))
    schema = "source string, seq long, text string, last boolean"
    for part in (first, second):
        part.write.mode("append").parquet(f"{base}/in")
        stream = streams.chunk_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), streams.fixed(700))
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.OUTPUT).parquet(f"{base}/out").select(F.col("source").cast("long").alias("doc_id"), "chunk_index", "content")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "q_markers": lambda s, sf: discourse.markers(marked(s, sf)),
    "q_topic_shift": shifts,
    "q_discourse_boundaries": breaks,
    "q_discourse_chunks": discourse_chunks,
    "q_chunk_model": modelled,
    "q_chunk_children": lambda s, sf: model.children(modelled(s, sf)),
    "q_modality_filter": lambda s, sf: model.of_modality(modelled(s, sf), "table").select("id", "size"),
    "q_metadata_merge": lambda s, sf: modelled(s, sf).select("id", model.merged_metadata(F.col("metadata"), {"position": F.lit(None), "level": F.col("chunk_index") % 3, "source": F.concat(F.lit("d"), F.col("doc_id").cast("string"))}).alias("metadata")),
    "q_xml_tags": lambda s, sf: markup.html_tags(order_xml(s, sf), ("order",), 1, form="xml"),
    "q_xml_hierarchy": lambda s, sf: markup.html_hierarchy(order_xml(s, sf), 2, 1, form="xml"),
    "q_xml_by_attr": lambda s, sf: markup.html_by_attribute(order_xml(s, sf), "status", form="xml"),
    "q_xml_by_type": lambda s, sf: markup.html_by_type(order_xml(s, sf), 10**9, 1, form="xml"),
    "q_code_outline": lambda s, sf: T.code_outline(code_text(CODE)(s, sf)),
    "q_strip_hash_comments": lambda s, sf: code_text(CODE)(s, sf).select("doc_id", T.without_comments(F.col("text"), "hash").alias("text")),
    "q_strip_slash_comments": lambda s, sf: code_text(SLASHES)(s, sf).select("doc_id", T.without_comments(F.col("text"), "slash").alias("text")),
    "q_sentences_by": lambda s, sf: closed.exploded(_docs(s, sf), T.sentences_by(T.filled(F.col("text")), ".,|")),
    "q_bare_words": lambda s, sf: _docs(s, sf).select("doc_id", F.size(T.bare_words(T.filled(F.col("text")))).cast("long").alias("n"), T.truncated(T.filled(F.col("text")), 100).alias("head")),
    "q_nfkc": lambda s, sf: T.normalised(_docs(s, sf)),
    "q_token_counts": lambda s, sf: tokens.counted(_docs(s, sf).select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens"),
    "q_token_spans": lambda s, sf: tokens.token_spans(_docs(s, sf), tokenizer_path(), 200, 20),
    "q_pdf_pages": lambda s, sf: pdf.pdf_pages(part_pdf(s, sf)),
    "q_byte_windows": lambda s, sf: windows.byte_windows(bytes_of(s, sf), 600, 40).select("path", "window", "start", "n_bytes"),
    "q_head_tail_digest": lambda s, sf: bytes_of(s, sf).select("path", windows.head_tail_digest(F.col("content"), 512).alias("digest")),
    "q_dump_json": dumped("json"),
    "q_dump_yaml": dumped("yaml"),
    "q_stream_tumbling": event_stream("tumbling"),
    "q_stream_sliding": event_stream("sliding"),
    "q_stream_distinct": event_stream("distinct"),
    "q_stream_resumed": resumed,
    "q_fitting": lambda s, sf: catalog.fitting(s, "text", "text", "medium").select("strategy", "complexity"),
}

_MARKED = f"(SELECT doc_id, i, CASE (doc_id + i) % 11 WHEN 3 THEN 'However, ' || sentence WHEN 5 THEN 'In summary, ' || sentence WHEN 8 THEN sentence || ' so then also' ELSE sentence END AS sentence FROM {_S})"
_PHRASES = "(VALUES " + ", ".join(f"('{kind}', '{p}', {w})" for kind, own in discourse.MARKERS.items() for p, w in own) + ") p(kind, phrase, weight)"
_MARKERS = rf"""(SELECT doc_id, i, kind, phrase, round(least(1.0, weight * CASE WHEN pre / n < 0.2 THEN 1.2 ELSE 1.0 END * CASE WHEN i = 0 THEN 1.1 ELSE 1.0 END * 0.7), 6)::DOUBLE AS strength FROM (
SELECT doc_id, i, kind, phrase, weight, length(sentence) AS n, CASE WHEN ends_with(phrase, '.') THEN length(regexp_extract(low, '(?s)^(|.*?[^\p{{L}}\p{{N}}_])' || replace(phrase, '.', '[.]') || '[\p{{L}}\p{{N}}_]', 1)) ELSE strpos(bare, ' ' || phrase || ' ') - 1 END AS pre,
CASE WHEN ends_with(phrase, '.') THEN regexp_matches(low, '(?s)^(|.*?[^\p{{L}}\p{{N}}_])' || replace(phrase, '.', '[.]') || '[\p{{L}}\p{{N}}_]') ELSE substring(low, CAST(strpos(bare, ' ' || phrase || ' ') AS BIGINT), length(phrase)) = phrase END AS hit
FROM (SELECT *, lower(sentence) AS low, ' ' || regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ' AS bare FROM {_MARKED}) s JOIN {_PHRASES} ON contains(bare, ' ' || rtrim(replace(phrase, '.', ' ')) || ' ')) WHERE hit)"""
_SHIFT = rf"""(WITH t AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {_MARKED}), m AS (SELECT doc_id, max(i) AS last FROM {_MARKED} GROUP BY doc_id),
x AS (SELECT doc_id, i + o AS b, CASE WHEN o > 0 THEN 1 ELSE 2 END AS side, term FROM t, (VALUES (1), (2), (0), (-1)) v(o)), c AS (SELECT x.doc_id, b, term, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS z FROM x JOIN m ON x.doc_id = m.doc_id AND b BETWEEN 1 AND last GROUP BY ALL),
s AS (SELECT doc_id, b, sum(a * z) AS dot, sqrt(sum(CASE WHEN a > 0 THEN power(a * CASE WHEN z > 0 THEN 1 ELSE ln(1.5) + 1 END, 2) ELSE 0 END)) AS na, sqrt(sum(CASE WHEN z > 0 THEN power(z * CASE WHEN a > 0 THEN 1 ELSE ln(1.5) + 1 END, 2) ELSE 0 END)) AS nz FROM c GROUP BY ALL)
SELECT w.doc_id, w.i, CASE WHEN s.dot IS NULL THEN 0.0 WHEN na > 0 AND nz > 0 THEN round(1 - dot / (na * nz), 9) ELSE 1.0 END AS shift FROM {_MARKED} w LEFT JOIN s ON w.doc_id = s.doc_id AND w.i = s.b WHERE w.i > 0)"""
_BOUNDS = f"""(SELECT * FROM (SELECT doc_id, i, round(semantic, 6) AS semantic, discourse, round(topic, 6) AS topic, 0.0::DOUBLE AS entity, round(semantic * (1 - 0.3 - 0.4 - 0.2) + discourse * 0.3 + topic * 0.4, 9) AS score FROM (
SELECT s.doc_id, s.i, coalesce(1 - round(c.sim, 6), 0) AS semantic, coalesce(d.discourse, 0) AS discourse, coalesce(t.shift, 0) AS topic FROM {_MARKED} s LEFT JOIN {_CUT} c ON s.doc_id = c.doc_id AND s.i = c.i + 1
LEFT JOIN (SELECT doc_id, i, max(strength) AS discourse FROM {_MARKERS} GROUP BY ALL) d ON s.doc_id = d.doc_id AND s.i = d.i LEFT JOIN {_SHIFT} t ON s.doc_id = t.doc_id AND s.i = t.i WHERE s.i > 0)) WHERE score >= 0.45)"""
_MODEL = f"""(SELECT doc_id, chunk_index, doc_id || '_' || chunk_index AS id, content, CASE WHEN contains(content, '|') THEN 'table' ELSE 'text' END AS modality, size, md5(content) AS hash, CASE WHEN chunk_index > 0 THEN doc_id || '_0' END AS parent_id,
'{{"chunker_used":"fixed_size",' || CASE WHEN chunk_index % 2 = 1 THEN '"position":' || chunk_index || ',' ELSE '' END || '"source":"' || doc_id || '"}}' AS metadata FROM ({_char_sql(900, 0)}))"""
_ORDERS = "(SELECT o_custkey AS page_id, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)"
_PARTS = lambda t: f"(SELECT p_partkey AS doc_id, replace(replace(replace('{t}', '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR)), '\\n', chr(10)) AS text FROM part)".replace("'a # b'", "''a # b''")
_WINDOW = "SELECT CAST(start AS VARCHAR) AS start, event_type, count(*) AS n FROM ({rows}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE FROM events) GROUP BY start, event_type"
_SLASH_SQL = _PARTS(SLASHES.replace("{{", "{").replace("}}", "}"))

ORACLE_SQL = {
    "q_markers": f"SELECT * FROM {_MARKERS}",
    "q_topic_shift": f"SELECT * FROM {_SHIFT}",
    "q_discourse_boundaries": f"SELECT *, CASE WHEN score > 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM {_BOUNDS}",
    "q_discourse_chunks": f"""WITH b AS MATERIALIZED (SELECT doc_id, i, score FROM {_BOUNDS}), k AS MATERIALIZED (SELECT doc_id, i, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM {_MARKERS} GROUP BY ALL),
r AS (SELECT s.doc_id, s.i, sentence, score, kinds, sum(CASE WHEN score IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS g FROM {_MARKED} s LEFT JOIN b ON s.doc_id = b.doc_id AND s.i = b.i LEFT JOIN k ON s.doc_id = k.doc_id AND s.i = k.i)
SELECT doc_id, CAST(g AS BIGINT) AS chunk_index, string_agg(sentence, ' ' ORDER BY i) AS content, count(*) AS sentences, max(CASE WHEN f THEN score END) AS score, coalesce(max(CASE WHEN f THEN kinds END), '') AS kinds FROM (SELECT *, i = min(i) OVER (PARTITION BY doc_id, g) AS f FROM r) GROUP BY doc_id, g""",
    "q_chunk_model": f"SELECT * FROM {_MODEL}",
    "q_chunk_children": f"SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, id) - 1 AS place, id FROM {_MODEL} WHERE parent_id IS NOT NULL",
    "q_modality_filter": f"SELECT id, size FROM {_MODEL} WHERE modality = 'table'",
    "q_metadata_merge": f"""SELECT id, '{{"chunker_used":"fixed_size","level":"' || chunk_index % 3 || '","source":"d' || doc_id || '"}}' AS metadata FROM {_MODEL}""",
    "q_xml_tags": f"SELECT page_id, r AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, 'order' AS tag FROM (SELECT page_id, r, k || ' ' || pr || ' &' AS c FROM {_ORDERS})",
    "q_xml_hierarchy": f"SELECT page_id, r * 3 + o AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, tag, CAST(d AS INT) AS depth FROM (SELECT page_id, r, unnest([0, 1, 2]) AS o, unnest(['&', CAST(k AS VARCHAR), pr]) AS c, unnest(['order', 'id', 'p']) AS tag, unnest([1, 2, 2]) AS d FROM {_ORDERS})",
    "q_xml_by_attr": f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY f) - 1 AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, st AS value FROM (SELECT page_id, st, min(r) AS f, string_agg(k || ' ' || pr || ' &', chr(10) || chr(10) ORDER BY r) AS c FROM {_ORDERS} GROUP BY page_id, st)",
    "q_xml_by_type": f"SELECT page_id, CAST(o AS BIGINT) AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, tag FROM (SELECT page_id, unnest([0, 1, 2]) AS o, unnest(['order', 'id', 'p']) AS tag, unnest([string_agg('&', chr(10) || chr(10) ORDER BY r), string_agg(CAST(k AS VARCHAR), chr(10) || chr(10) ORDER BY r), string_agg(pr, chr(10) || chr(10) ORDER BY r)]) AS c FROM {_ORDERS} GROUP BY page_id)",
    "q_code_outline": f"SELECT doc_id, k AS line, CASE WHEN regexp_matches(c, '(def|function|func|fn|sub|procedure) ') THEN 'function' ELSE 'class' END AS kind, c AS content FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, trim(unnest(string_split(text, chr(10)))) AS c FROM {_PARTS(CODE)}) WHERE regexp_matches(c, '(def|function|func|fn|sub|procedure|class|interface|struct|type|enum) ')",
    "q_strip_hash_comments": f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, '#') AND NOT contains(x, chr(39)) AND NOT contains(x, '\"') THEN string_split(x, '#')[1] ELSE x END), chr(10)) AS text FROM {_PARTS(CODE)}",
    "q_strip_slash_comments": f"SELECT doc_id, regexp_replace(regexp_replace(text, '//.*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS text FROM {_SLASH_SQL}",
    "q_sentences_by": rf"SELECT doc_id, k AS chunk_index, x AS content, CAST(length(x) AS BIGINT) AS size FROM (SELECT doc_id, unnest(u) AS x, unnest(range(0, len(u))) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.,|]+{SPACE}*[\"'']?{SPACE}*)', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') AS u FROM documents))",
    "q_bare_words": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n, CASE WHEN length(text) <= 100 THEN text WHEN strpos(reverse(h), ' ') > 0 AND 100 - strpos(reverse(h), ' ') > 80 THEN substring(h, 1, 100 - strpos(reverse(h), ' ')) ELSE h END AS head FROM (SELECT doc_id, coalesce(text, '') AS text, substring(coalesce(text, ''), 1, 100) AS h FROM documents)",
    "q_nfkc": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{202f}\\x{205f}\\x{3000}]', ' ', 'g'), '[\\x{2010}-\\x{2015}]', '-', 'g'), '[\\x{2018}\\x{2019}]', '''', 'g'), '[\\x{201c}\\x{201d}]', '\"', 'g') AS text FROM documents",
    "q_pdf_pages": "SELECT path, CAST(k AS BIGINT) AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, CAST(k + 1 AS INT) AS first_page, CAST(k + 1 AS INT) AS last_page FROM (SELECT p_partkey AS path, unnest([0, 1]) AS k, unnest([p_type || chr(10) || 'size is ' || p_size, p_name || chr(10) || 'size is ' || p_size]) AS c FROM part)",
    "q_byte_windows": 'SELECT path, p // 600 AS "window", greatest(0, p - 40) AS start, least(n, p + 600) - greatest(0, p - 40) AS n_bytes FROM (SELECT doc_id AS path, octet_length(encode(coalesce(text, \'\'))) AS n, unnest(range(0, octet_length(encode(coalesce(text, \'\'))), 600)) AS p FROM documents)',
    "q_head_tail_digest": "SELECT doc_id AS path, md5(unhex(substring(h, 1, 1024) || CASE WHEN length(h) > 1024 THEN substring(h, greatest(1, length(h) - 1023), 1024) ELSE '' END)) AS digest FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)",
    "q_dump_json": f"SELECT doc_id, chunk_index, replace(content, '\\', '/') AS content, size FROM ({_char_sql(800, 0)})",
    "q_dump_yaml": f"SELECT doc_id, chunk_index, replace(content, '\\', '/') AS content, size FROM ({_char_sql(800, 0)})",
    "q_stream_tumbling": _WINDOW.format(rows="SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, event_type FROM events"),
    "q_stream_sliding": _WINDOW.format(rows="SELECT time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) - o * INTERVAL 15 MINUTE AS start, event_type FROM events, range(0, 4) t(o)"),
    "q_stream_distinct": "SELECT event_id FROM events",
    "q_stream_resumed": "SELECT doc_id, k AS chunk_index, substring(text, k * 700 + 1, 700) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM documents)",
}
