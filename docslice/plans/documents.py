"""Queries on CSV, JSON, Markdown, HTML, code and sentence semantics, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.functions import text as T
from docslice.operators import code, markup, semantic, structured, vectors
from docslice.plans.splits import LINED, SENTENCES, SPACE, joined_sql
from docslice.operators.kernel import spread
from docslice.runtime import table

ORDER_HEADER = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as the rows of a CSV document."""
    o = table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), place.cast("long").alias("place"), F.array(*(F.col(c).cast("string") for c in ORDER_HEADER)).alias("cells"))


_ROWS = "(SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderstatus AS st, o_orderpriority AS pr, concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders)"
_HEAD = ",".join(ORDER_HEADER)


def csv_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit(', ""x""",'), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("id,label,size\r\n"), line, F.lit("\r\n\r\n"), line).alias("text"))


def event_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a JSON array."""
    e = table(spark, sf, "events")
    obj = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.when(F.col("event_type") != "click", F.col("event_type"))).alias("kind")))
    return e.groupBy(F.col("user_id").alias("doc_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", obj.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("text"))


_EVENT = "(SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS kind, '{\"id\":' || event_id || CASE WHEN event_type NOT IN ('view', 'click') THEN ',\"kind\":\"' || event_type || '\"' ELSE '' END || '}' AS j FROM events)"


def nested_json(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    deep = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.struct(F.array(F.col("p_type"), F.col("p_brand"), F.lit("x")).alias("tags")).alias("inner")).alias("more"), F.sequence(F.lit(0), F.col("p_size")).alias("nums"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.to_json(deep).alias("text"))


def _line(x: Column, i: Column) -> Column:
    return F.when(i % 7 == 0, F.concat(F.lit("# "), x)).when(i % 7 == 3, F.concat(F.lit("## "), x)).when(i % 7 == 5, F.concat(F.lit("- "), x)).otherwise(x)


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with marks on some of their lines and blank lines between."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), _line), "\n\n").alias("text"))


_MD = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN '# ' || x WHEN (i - 1) % 7 = 3 THEN '## ' || x WHEN (i - 1) % 7 = 5 THEN '- ' || x ELSE x END), chr(10) || chr(10)) AS text FROM documents)"

PYTHON = "import os\\n\\n\\ndef f{k}(x):\\n    return x + {k}\\n\\n\\nclass C{k}:\\n    def m(self):\\n        pass\\n\\n    async def n(self):\\n        return {s}\\n\\n\\nprint(f{k}({s}))\\n"
BRACES = {
    "c": '#include <x.h>\\nstruct P{k} {{\\n  int a;\\n}};\\nint f{k}(int x) {{\\n  if (x) {{ return "}}"[0]; }}\\n  return {s};\\n}}\\n',
    "javascript": "import a from 'b';\\nclass K{k} {{\\n  m(x) {{ return '}}'; }}\\n}}\\nfunction g{k}(y) {{\\n  if (y) {{ return {s}; }}\\n}}\\nconst h = (z) => {{\\n  return z;\\n}};\\n",
    "go": "package p\\nimport \"fmt\"\\ntype S{k} struct {{\\n  a int\\n}}\\ntype I{k} interface {{\\n  M()\\n}}\\nfunc (s S{k}) M() {{\\n  fmt.Println({s})\\n}}\\n",
    "java": "package a.b;\\nimport java.util.List;\\npublic class J{k} {{\\n  private int f = {s};\\n  public int get(int x) {{\\n    return x;\\n  }}\\n}}\\n",
}
CSS = "@import 'x';\\n#a{k}, .b > c:hover {{\\n  top: {s}px;\\n}}\\n@media print {{\\n  p {{ margin: 0; }}\\n}}\\n* {{ color: red; }}\\n"


def code_text(template: str):
    """A file for each part from a template with {k} and {s}."""
    own = template.replace("\\n", "\n")

    def make(spark: SparkSession, sf: str) -> DataFrame:
        text = F.lit(own.replace("{{", "\x02").replace("}}", "\x03"))
        text = F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
        return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.translate(text, "\x02\x03", "{}").alias("text"))

    return make


def _brace(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for language, template in BRACES.items():
        found = code.code(code_text(template)(spark, sf), language, ("function", "class", "struct", "interface", "method", "import", "package", "preprocessor", "field")).withColumn("language", F.lit(language))
        out = found if out is None else out.unionByName(found)
    return out


def guessed(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all templates by their text, and of made-up paths."""
    out = None
    for name, template in {"python": PYTHON, "css": CSS, **BRACES}.items():
        some = code_text(template)(spark, sf).select("doc_id", F.lit(name).alias("template"), code.guess_language(F.col("text")).alias("language"), code.guess_language(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("a/b.RS")).otherwise(F.lit("x"))).alias("by_path"))
        out = some if out is None else out.unionByName(some)
    return out


def selectors(spark: SparkSession, sf: str) -> DataFrame:
    rules = code.code(code_text(CSS)(spark, sf), "css", ("rule",))
    n = lambda p: T.count(F.col("name"), p)
    return rules.select("doc_id", "chunk_index", n(r"#[\w-]+").alias("ids"), n(r"\.[\w-]+|\[[^\]]+\]|(?<!:):[\w-]+").alias("classes"), n(r"(?:^|[\s>+~,])[a-zA-Z][\w-]*").alias("elements"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.sentence_table(_docs(spark, sf))


def _sims(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.consecutive(semantic.with_vectors(_sentences(spark, sf)))


def _vectors(features):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = semantic.with_vectors(_sentences(spark, sf), features)
        return v.select("doc_id", "i", *(F.round(F.col("v")[k], 6).alias(f"f{k}") for k in range(8 if features is semantic.surface_features else 5)))

    return run


def all_metrics(spark: SparkSession, sf: str) -> DataFrame:
    v = semantic.with_vectors(_sentences(spark, sf))
    out = None
    for m in ("cosine", "euclidean", "dot", "manhattan"):
        s = semantic.consecutive(v, m).groupBy("doc_id").agg(F.round(F.avg("sim"), 6).alias("mean_sim")).withColumn("metric", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out


def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e.filter("vec_id % 100 = 0"), e, 5)


def vector_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.normalised(table(spark, sf, "embeddings"))
    return v.select("vec_id", F.round(F.sqrt(semantic.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return _events(spark, sf).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n", "total")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user with gaps of 30 minutes at most."""
    w = F.session_window("ts", "30 minutes")
    return _events(spark, sf).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").cast("string").alias("start"), "n")


QUERIES = {
    "q_csv_rows": lambda s, sf: structured.csv_rows(order_rows(s, sf), ORDER_HEADER, 4),
    "q_csv_rows_overlap": lambda s, sf: structured.csv_rows(order_rows(s, sf), ORDER_HEADER, 4, 1),
    "q_csv_groups": lambda s, sf: structured.csv_groups(order_rows(s, sf), ORDER_HEADER, "o_orderstatus"),
    "q_csv_memory": lambda s, sf: structured.csv_memory(order_rows(s, sf), ORDER_HEADER, 64),
    "q_csv_header_sections": lambda s, sf: structured.csv_sections(order_rows(s, sf).withColumn("cells", F.when(F.col("place") % 3 == 0, F.transform("cells", lambda x: F.concat(F.lit("X"), F.upper(x)))).otherwise(F.col("cells"))), ORDER_HEADER),
    "q_csv_parse": lambda s, sf: structured.parse_csv(csv_text(s, sf)).select("doc_id", "place", F.array_join("cells", "^").alias("cells")),
    "q_json_objects": lambda s, sf: structured.json_objects(event_json(s, sf), 5),
    "q_json_key_groups": lambda s, sf: structured.json_key_groups(event_json(s, sf), "kind"),
    "q_json_array": lambda s, sf: structured.json_arrays(nested_json(s, sf), 10),
    "q_json_depth": lambda s, sf: structured.json_depth(nested_json(s, sf), 2),
    "q_json_size": lambda s, sf: structured.json_size(event_json(s, sf), 200),
    "q_md_headers": lambda s, sf: markup.markdown_headers(markdown(s, sf)),
    "q_md_sections": lambda s, sf: markup.markdown_sections(markdown(s, sf)),
    "q_md_blocks": lambda s, sf: markup.markdown_blocks(markdown(s, sf)),
    "q_md_fixed": lambda s, sf: markup.markdown_fixed(markdown(s, sf)),
    "q_md_structure": lambda s, sf: markup.markdown_structure(markdown(s, sf)),
    "q_html_tags": lambda s, sf: markup.html_tags(table(s, sf, "pages")),
    "q_html_semantic": lambda s, sf: markup.html_semantic(table(s, sf, "pages")),
    "q_html_hierarchy": lambda s, sf: markup.html_hierarchy(table(s, sf, "pages")),
    "q_html_by_type": lambda s, sf: markup.html_by_type(table(s, sf, "pages")),
    "q_html_by_attr": lambda s, sf: markup.html_by_attribute(table(s, sf, "pages")),
    "q_html_size": lambda s, sf: markup.html_by_size(table(s, sf, "pages")),
    "q_html_counts": lambda s, sf: markup.html_counts(table(s, sf, "pages")),
    "q_boundary_format": lambda s, sf: markup.text_format(markdown(s, sf)),
    "q_boundary_plain": lambda s, sf: markup.boundary_aware(_docs(s, sf).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))),
    "q_boundary_markdown": lambda s, sf: markup.boundary_aware(markdown(s, sf)),
    "q_python_code": lambda s, sf: code.code(code_text(PYTHON)(s, sf), "python", ("function", "class", "method", "import"), rest=True),
    "q_python_blocks": lambda s, sf: code.code(code_text(PYTHON)(s, sf), "python", None, 8),
    "q_brace_code": _brace,
    "q_css_code": lambda s, sf: code.code(code_text(CSS)(s, sf), "css", ("rule", "media_query", "at_rule", "mixin")),
    "q_css_selectors": selectors,
    "q_code_lines": lambda s, sf: code.code_lines(code_text(PYTHON)(s, sf), 4),
    "q_code_indentation": lambda s, sf: code.code_indentation(code_text(PYTHON)(s, sf), 6),
    "q_code_language": guessed,
    "q_surface_features": _vectors(semantic.surface_features),
    "q_word_features": _vectors(semantic.word_features),
    "q_consecutive_similarity": lambda s, sf: _sims(s, sf).select("doc_id", "i", F.round("sim", 6).alias("sim")),
    "q_similarity_metrics": all_metrics,
    "q_threshold_boundaries": lambda s, sf: semantic.by_threshold(_sims(s, sf)).select("doc_id", "i", "strength"),
    "q_window_boundaries": lambda s, sf: semantic.by_window(_sims(s, sf)).select("doc_id", "i"),
    "q_dynamic_boundaries": lambda s, sf: semantic.by_spread(_sims(s, sf)).select("doc_id", "i"),
    "q_coherence_boundaries": lambda s, sf: semantic.by_coherence(_sims(s, sf)).select("doc_id", "i"),
    "q_adaptive_threshold": lambda s, sf: semantic.adaptive_threshold(_sims(s, sf)),
    "q_semantic_chunks": lambda s, sf: semantic.semantic_chunks(_sentences(s, sf), semantic.by_threshold(_sims(s, sf))),
    "q_semantic_segments": lambda s, sf: semantic.segments(_sentences(s, sf), semantic.by_threshold(_sims(s, sf))),
    "q_context_enriched": lambda s, sf: semantic.context_enriched(_sentences(s, sf), semantic.by_spread(_sims(s, sf))),
    "q_tfidf": lambda s, sf: semantic.tfidf(_sentences(s, sf)).select("doc_id", "i", "term", F.round("weight", 6).alias("weight")),
    "q_tfidf_similarity": lambda s, sf: semantic.neighbours(_sentences(s, sf)).filter("sim is not null").select("doc_id", "i", "sim"),
    "q_kmeans_boundaries": lambda s, sf: semantic.cluster_chunks(semantic.with_vectors(_sentences(s, sf))),
    "q_ward_boundaries": lambda s, sf: semantic.cluster_chunks(semantic.with_vectors(_sentences(s, sf)), "ward"),
    "q_dbscan_boundaries": lambda s, sf: semantic.cluster_chunks(semantic.with_vectors(_sentences(s, sf)), "dbscan"),
    "q_top_words": lambda s, sf: semantic.top_words(_docs(s, sf).select("doc_id", F.col("text").alias("content")), 20),
    "q_vector_norm": vector_norm,
    "q_vector_cosine_topk": vector_top_k,
    "q_vector_export": lambda s, sf: vectors.export(table(s, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("embedding"), "label"), ["label"]),
    "q_embed_text": lambda s, sf: vectors.embed_text(_docs(s, sf).select("doc_id", F.col("text").alias("content"))).select("doc_id", F.round(F.array_max("embedding"), 6).alias("largest")),
    "q_event_tumbling": tumbling,
    "q_event_session": sessions,
    "q_event_dedup": lambda s, sf: _events(s, sf).groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id")),
}

_S = f"(SELECT doc_id, unnest(range(0, len(u))) AS i, unnest(u) AS sentence FROM (SELECT doc_id, {SENTENCES.format(c='text')} AS u FROM documents))"
_N = "CAST(len(regexp_extract_all(sentence, '{p}')) AS DOUBLE)"
_W = _N.format(p=r"[^ \t\n\v\f\r]+")
_FEATURES = [
    "length(sentence) / 100", f"{_W} / 20", f"{_N.format(p='[,;:]')} / 5", f"{_N.format(p=chr(92) + 'p{Lu}')} / 10", f"{_N.format(p='[0-9]')} / 10", "CASE WHEN ends_with(sentence, '?') THEN 1.0 ELSE 0.0 END",
    "CASE WHEN ends_with(sentence, '!') THEN 1.0 ELSE 0.0 END", f"CASE WHEN {_W} > 0 THEN length(sentence) / {_W} / 10 ELSE 0 END",
]
_SURFACE = f"(SELECT doc_id, i, {', '.join(f'CAST({x} AS DOUBLE) AS f{k}' for k, x in enumerate(_FEATURES))} FROM {_S})"
_V = "[" + ", ".join(f"f{k}" for k in range(8)) + "]"
_SIM = f"(SELECT doc_id, i, round(CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(nv, nv) > 0 THEN greatest(0.0, list_dot_product(v, nv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nv, nv)))) ELSE 0 END, 9) AS sim FROM (SELECT doc_id, i, {_V} AS v, lead({_V}) OVER (PARTITION BY doc_id ORDER BY i) AS nv FROM {_SURFACE}) WHERE nv IS NOT NULL)"
_CUT = f"(SELECT * FROM {_SIM} WHERE sim < 0.7)"
_TF = rf"""WITH e AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {_S}), tf AS (SELECT doc_id, i, term, count(*) AS tf FROM e GROUP BY ALL), d AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM {_S} GROUP BY ALL),
w AS (SELECT doc_id, i, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (doc_id, term) JOIN n USING (doc_id)), u AS (SELECT doc_id, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, i)) AS weight FROM w)"""
ORACLE_SQL = {
    "q_csv_rows": f"SELECT doc_id, place // 4 AS chunk_index, '{_HEAD}' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY place) || chr(13) || chr(10) AS content, count(*) AS n_rows FROM {_ROWS} GROUP BY doc_id, place // 4",
    "q_csv_rows_overlap": f"SELECT doc_id, b AS chunk_index, '{_HEAD}' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY place) || chr(13) || chr(10) AS content, count(*) AS n_rows FROM (SELECT *, unnest(CASE WHEN place % 4 >= 3 THEN [place // 4, place // 4 + 1] ELSE [place // 4] END) AS b FROM {_ROWS}) GROUP BY doc_id, b",
    "q_csv_groups": f"WITH g AS (SELECT doc_id, st AS value, min(place) AS f, '{_HEAD}' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY place) || chr(13) || chr(10) AS content, count(*) AS n_rows FROM {_ROWS} GROUP BY doc_id, st) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS chunk_index, value, content, n_rows FROM g",
    "q_csv_memory": f"SELECT doc_id, chunk_index, '{_HEAD}' || chr(13) || chr(10) || content AS content, CAST(length('{_HEAD}' || chr(13) || chr(10) || content) AS BIGINT) AS size FROM ({joined_sql('u', 'chr(13) || chr(10)', 64, f'(SELECT doc_id, list(line ORDER BY place) AS u FROM {_ROWS} GROUP BY doc_id)', count_sep=False)})",
    "q_json_objects": f"WITH b AS (SELECT doc_id, place // 5 AS k, '[' || string_agg(j, ',' ORDER BY place) || ']' AS content FROM {_EVENT} GROUP BY doc_id, place // 5) SELECT doc_id, k AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM b",
    "q_json_key_groups": f"WITH g AS (SELECT doc_id, coalesce(kind, 'ungrouped') AS value, count(*) AS n, min(place) AS f, '[' || string_agg(j, ',' ORDER BY place) || ']' AS content FROM {_EVENT} GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN value = 'ungrouped' THEN 1 ELSE 0 END, f) - 1 AS chunk_index, value, n, content FROM g",
    "q_html_counts": "SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY lower(t)",
    "q_md_sections": joined_sql("u", "chr(10) || chr(10)", 2000, rf"""(SELECT doc_id, list(s ORDER BY g) AS u FROM (SELECT doc_id, g, string_agg(t, chr(10) || chr(10) ORDER BY i) AS s FROM (SELECT doc_id, i, t, sum(CASE WHEN regexp_matches(t, '^#{{1,6}}[ \t]+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, unnest(u) AS t, unnest(range(0, len(u))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{SPACE}+', ''), '{SPACE}+$', '')), lambda x: x <> '') AS u FROM {_MD}))) GROUP BY doc_id, g) GROUP BY doc_id)"""),
    "q_surface_features": f"SELECT doc_id, i, {', '.join(f'round(f{k}, 6) AS f{k}' for k in range(8))} FROM {_SURFACE}",
    "q_word_features": rf"""WITH w AS (SELECT doc_id, i, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS w FROM {_S})
SELECT doc_id, i, CAST(len(w) AS DOUBLE) AS f0, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS f1, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS f2, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) > 6)) / len(w) ELSE 0 END, 6) AS f3, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) < 4)) / len(w) ELSE 0 END, 6) AS f4 FROM w""",
    "q_consecutive_similarity": f"SELECT doc_id, i, round(sim, 6) AS sim FROM {_SIM}",
    "q_threshold_boundaries": f"SELECT doc_id, i, CASE WHEN sim < 0.5 THEN 'strong' ELSE 'moderate' END AS strength FROM {_CUT}",
    "q_window_boundaries": f"SELECT doc_id, i FROM (SELECT doc_id, i, sim, avg(sim) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, avg(sim) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM {_SIM}) WHERE sim < l - 0.1 AND sim < r - 0.1",
    "q_dynamic_boundaries": f"SELECT doc_id, i FROM (SELECT doc_id, i, sim, avg(sim) OVER (PARTITION BY doc_id) AS m, stddev_pop(sim) OVER (PARTITION BY doc_id) AS s FROM {_SIM}) WHERE sim < greatest(0.3, m - s)",
    "q_coherence_boundaries": f"SELECT doc_id, i FROM (SELECT doc_id, i, round((1 - sim) * 0.7 + (1 - coalesce(avg(sim) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), sim)) * 0.3, 9) AS score FROM {_SIM}) WHERE score > 0.5",
    "q_adaptive_threshold": f"SELECT doc_id, round(least(0.9, greatest(0.1, avg(sim) - CASE WHEN coalesce(stddev_pop(sim), 0) < 0.1 THEN 0.5 * coalesce(stddev_pop(sim), 0) ELSE coalesce(stddev_pop(sim), 0) END)), 6) AS threshold FROM {_SIM} GROUP BY doc_id",
    "q_semantic_segments": f"WITH s AS (SELECT a.doc_id, a.i, sentence, coalesce(sum(CASE WHEN b.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY a.i), 0) AS g FROM {_S} a LEFT JOIN {_CUT} b ON a.doc_id = b.doc_id AND a.i = b.i + 1) SELECT doc_id, CAST(g AS BIGINT) AS chunk_index, string_agg(sentence, ' ' ORDER BY i) AS content, count(*) AS sentences FROM s GROUP BY doc_id, g",
    "q_tfidf": f"{_TF} SELECT doc_id, i, term, round(weight, 6) AS weight FROM u",
    "q_tfidf_similarity": f"{_TF} SELECT a.doc_id AS doc_id, a.i AS i, round(sum(a.weight * b.weight), 6) AS sim FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i + 1 = b.i GROUP BY a.doc_id, a.i",
    "q_top_words": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM c) SELECT * FROM r WHERE place <= 20",
    "q_vector_norm": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, 1.0 AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v",
    "q_vector_cosine_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS c FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(c, 6) AS cosine FROM r WHERE rank <= 5",
    "q_event_tumbling": "SELECT CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "q_event_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(CAST(min(ts) AS TIMESTAMP) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "q_event_dedup": "SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL",
}
ORACLE_SQL["q_md_structure"] = (
    "SELECT doc_id, " + ", ".join(rf"CAST(len(regexp_extract_all(text, '(?m)^#{{{k}}}[ \t]')) AS BIGINT) AS h{k}" for k in (1, 2, 3)) + rf", CAST(len(regexp_extract_all(text, '```[\s\S]*?```')) AS BIGINT) AS code, CAST(len(regexp_extract_all(text, '(?m)^\|')) AS BIGINT) AS table_lines, CAST(len(regexp_extract_all(text, '(?m)^[ \t]*[-*+][ \t]')) AS BIGINT) AS items, regexp_matches(text, '\A---') AS frontmatter FROM {_MD}"
)
_LINES = "array_to_string(list_slice(l, k * 4 + 1, k * 4 + 4), chr(10))"
ORACLE_SQL["q_code_lines"] = f"WITH p AS (SELECT p_partkey AS doc_id, string_split(replace(replace('{PYTHON}', '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR)), '\\n') AS l FROM part), e AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(len(l) / 4) AS BIGINT))) AS k FROM p) SELECT doc_id, k AS chunk_index, {_LINES} AS content, CAST(length({_LINES}) AS BIGINT) AS size FROM e"
