"""Strategy catalogue, chunk pipelines from a configuration, and the SQL surface."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.operators import cdc, chunkops, closed, discourse, markup, pack, plugins, semantic, structured

Strategy = Callable[..., DataFrame]


def _semantic(df: DataFrame, threshold: float = 0.7, least: int = 2, most: int = 15, **_) -> DataFrame:
    s = semantic.sentence_table(df)
    sims = semantic.consecutive(semantic.with_vectors(s))
    return semantic.semantic_chunks(s, semantic.by_threshold(sims, threshold), least, most)


def _context(df: DataFrame, **settings) -> DataFrame:
    s = semantic.sentence_table(df)
    return semantic.context_enriched(s, semantic.by_spread(semantic.consecutive(semantic.with_vectors(s))), **settings)


def _discourse(df: DataFrame, least: float = 0.6, sensitivity: float = 0.7, **_) -> DataFrame:
    s = semantic.sentence_table(df)
    cuts = semantic.by_threshold(semantic.consecutive(semantic.with_vectors(s)))
    found = discourse.boundaries(s, cuts, discourse.topic_shift(s), least=least, sensitivity=sensitivity)
    return discourse.chunks(s, found, discourse.markers(s, sensitivity))


def _clustered(df: DataFrame, method: str = "kmeans", **settings) -> DataFrame:
    return semantic.cluster_chunks(semantic.with_vectors(semantic.sentence_table(df)), method, **settings)


#: name: (function, category, speed and quality from 0 to 1)
STRATEGIES: dict[str, tuple[Strategy, str, float, float]] = {
    "fixed_size": (closed.fixed_size, "general", 1.0, 0.4),
    "universal_fixed": (closed.universal_fixed, "general", 1.0, 0.4),
    "universal_window": (closed.universal_window, "general", 0.9, 0.5),
    "word_windows": (closed.word_windows, "text", 0.9, 0.5),
    "overlapping_window": (closed.overlapping_window, "text", 0.9, 0.5),
    "token_based": (closed.token_windows, "text", 0.9, 0.6),
    "character_windows": (pack.character_windows, "text", 0.8, 0.5),
    "sentence_based": (pack.sentence_based, "text", 0.7, 0.8),
    "paragraph_based": (pack.paragraph_based, "text", 0.7, 0.8),
    "universal_sentence": (pack.universal_sentence, "text", 0.7, 0.7),
    "universal_paragraph": (pack.universal_paragraph, "text", 0.7, 0.7),
    "universal_document": (pack.universal_document, "document", 0.7, 0.6),
    "recursive": (pack.recursive, "text", 0.5, 0.8),
    "boundary_aware": (markup.boundary_aware, "text", 0.5, 0.8),
    "markdown": (markup.markdown_headers, "document", 0.6, 0.8),
    "semantic": (_semantic, "text", 0.3, 0.9),
    "context_enriched": (_context, "text", 0.3, 0.9),
    "discourse_aware": (_discourse, "text", 0.3, 0.8),
    "embedding_based": (_clustered, "text", 0.3, 0.8),
    "pattern_sections": (plugins.pattern_sections, "custom", 0.7, 0.6),
    "sentiment_groups": (plugins.sentiment_groups, "custom", 0.7, 0.5),
    "balanced_length": (plugins.balanced_length, "custom", 0.6, 0.7),
    "json": (structured.json_objects, "data", 0.9, 0.7),
    "html": (partial(markup.html_semantic, html="text", key="doc_id"), "document", 0.5, 0.7),
    "xml": (partial(markup.html_semantic, html="text", key="doc_id", form="xml"), "document", 0.5, 0.7),
    **{name: (partial(cdc.content_defined, rule=rule), "content_defined", 0.6, 0.5) for name, rule in (("fastcdc", cdc.fastcdc), ("rolling_hash", cdc.rolling_polynomial), ("rabin_fingerprinting", cdc.rabin), ("buzhash", cdc.buzhash), ("gear_cdc", cdc.gear_cdc), ("ml_cdc", cdc.ml_cdc), ("tttd", cdc.tttd), ("universal_rolling", cdc.universal_rolling))},
}


def register(name: str, function: Strategy, category: str = "custom", speed: float = 0.5, quality: float = 0.5, override: bool = False) -> None:
    if name in STRATEGIES and not override:
        raise ValueError(f"{name} is registered already")
    STRATEGIES[name] = (function, category, speed, quality)


def unregister(name: str) -> None:
    STRATEGIES.pop(name, None)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, s, q) for k, (_, c, s, q) in STRATEGIES.items()], "strategy string, category string, speed double, quality double")


#: Kinds of content, and the file endings, that a category of strategies takes.
TAKES = {"general": (("text", "mixed"), ()), "text": (("text",), (".txt", ".md")), "document": (("text",), (".md", ".html", ".xml", ".docx", ".odt", ".rtf", ".pdf")), "data": (("text", "table"), (".json", ".jsonl", ".csv")), "content_defined": (("text", "mixed"), (".bin", ".zip")), "custom": (("text",), ())}


def described(spark: SparkSession) -> DataFrame:
    """The catalogue with complexity (low, medium, high by speed), modalities, endings and memory."""
    rows = []
    for name, (function, category, speed, quality) in STRATEGIES.items():
        kinds, endings = TAKES.get(category, (("text",), ()))
        about = (function.func if isinstance(function, partial) else function).__doc__ or ""
        rows.append((name, category, speed, quality, "low" if speed >= 0.8 else "medium" if speed >= 0.5 else "high", list(kinds), list(endings), "a batch of rows" if category == "content_defined" else "a row", " ".join(about.split())))
    return spark.createDataFrame(rows, "strategy string, category string, speed double, quality double, complexity string, modalities array<string>, endings array<string>, memory string, about string")


def fitting(spark: SparkSession, category: str | None = None, modality: str | None = None, complexity: str | None = None) -> DataFrame:
    """Strategies of a category, that take a modality, of a complexity, by name."""
    out = described(spark)
    if category is not None:
        out = out.filter(F.col("category") == category)
    if modality is not None:
        out = out.filter(F.array_contains("modalities", modality))
    if complexity is not None:
        out = out.filter(F.col("complexity") == complexity)
    return out.orderBy("strategy")


def recommended(spark: SparkSession, priority: str = "balanced", most: int = 5) -> DataFrame:
    score = {"speed": F.col("speed"), "quality": F.col("quality"), "balanced": (F.col("speed") + F.col("quality")) / 2}[priority]
    return catalogue(spark).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "strategy").limit(most)


def chunk(df: DataFrame, strategy: str, **settings) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy][0](df, **settings)


def multi(df: DataFrame, strategies: list[str]) -> DataFrame:
    """Chunks of several strategies, told apart by a column."""
    out = None
    for s in strategies:
        made = chunk(df, s).select("doc_id", "chunk_index", "content", F.length("content").cast("long").alias("size"), F.lit(s).alias("strategy"))
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no strategies")
    return out


BEFORE = {"spaces": T.normal_spaces, "frames": T.without_frames, "markup": T.without_markup, "quotes": T.plain_quotes}
AFTER: dict[str, Callable[..., DataFrame]] = {
    "filter": chunkops.keep_sizes,
    "remove_empty": chunkops.remove_empty,
    "merge_short": chunkops.merge_short,
    "drop_similar": chunkops.drop_similar,
    "enrich": chunkops.enrich,
}


def run(df: DataFrame, config: dict) -> DataFrame:
    """{"before": [names], "strategy": name, "settings": {}, "after": [{"step": name, ...}]}: a plan, lazily built."""
    text = T.filled(F.col("text"))
    for name in config.get("before", []):
        text = BEFORE[name](text)
    out = chunk(df.withColumn("text", text), config.get("strategy", "sentence_based"), **config.get("settings", {}))
    for step in config.get("after", []):
        settings = dict(step)
        out = AFTER[settings.pop("step")](out, **settings)
    return out


def register_sql(spark: SparkSession) -> None:
    """Table functions for SQL: fixed_chunks(text, size) and sentence_chunks(text, most)."""
    from pyspark.sql.functions import udtf

    class FixedChunks:
        def eval(self, text: str, size: int):
            for k, i in enumerate(range(0, len(text or ""), size)):
                yield k, text[i : i + size]

    class SentenceChunks:
        def eval(self, text: str, most: int):
            import re

            parts = [x.strip() for x in re.sub(r"([.!?]+)(\s+|\Z)", "\\1\x01", text or "").split("\x01") if x.strip()]
            for k, i in enumerate(range(0, len(parts), most)):
                yield k, " ".join(parts[i : i + most])

    for name, c in (("fixed_chunks", FixedChunks), ("sentence_chunks", SentenceChunks)):
        spark.udtf.register(name, udtf(c, returnType="chunk_index int, content string"))
