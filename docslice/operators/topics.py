"""Topics of a document's sentences, and boundaries by similarity, topic and entity.

Labels of topics come from clusters of TF-IDF vectors (one document at a time), or from any table (key, i, topic).
Everything after the labels is aggregates and windows. The coherence of a topic is the mean cosine of all pairs of its
sentences; of unit vectors v that is (|sum v|^2 - n) / (n (n - 1)), so no pair is ever formed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docslice.operators.kernel import chunk_rows
from docslice.operators.semantic import _sliced, _weighed, by_document, neighbours, order
from docslice.runtime import arrow_rows


def _labels(units: list, terms: list[list[str]], most: int) -> Iterator[tuple]:
    n = len(units)
    if n < 3:
        return
    df = Counter(t for own in terms for t in set(own))
    tf = Counter(t for own in terms for t in own)
    names = sorted(df, key=lambda t: (-tf[t], t))[:most]
    at = {t: k for k, t in enumerate(sorted(names))}
    x = np.zeros((n, max(1, len(at))))
    rows, columns = [], []
    for i, own in enumerate(terms):
        found = [at[t] for t in own if t in at]
        columns += found
        rows += [i] * len(found)
    np.add.at(x, (np.array(rows, int), np.array(columns, int)), 1)
    x *= np.log((1 + n) / (1 + np.array([df[t] for t in sorted(names)] or [0]))) + 1
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    k = min(max(2, n // 3), 5)
    centres = x[np.linspace(0, n - 1, k).astype(int)].copy()
    label = np.full(n, -1)
    for _ in range(50):
        new = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        if (new == label).all():
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centres[j] = x[label == j].mean(0)
    for i in range(n):
        yield "", i, int(label[i])


def _labels_of_words(terms: list[list[str]], most: int) -> Iterator[tuple]:
    return _labels(terms, terms, most)


def topic_labels(sentences: DataFrame, most: int = 1000, key: str = "doc_id") -> DataFrame:
    """key, i, topic of documents of three sentences or more: min(max(2, n / 3), 5) clusters of TF-IDF vectors of at
    most `most` terms, from evenly placed first centres."""
    by = by_document(sentences, (), key)
    return chunk_rows(by, partial(_labels_of_words, most=most), ["words"], "i long, topic int", key).select(key, "i", "topic")


def topic_coherence(sentences: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, topic, n, coherence: mean cosine of the topic's sentences, TF-IDF within the topic; 1 for a single one."""
    own = sentences.join(labels, [key, "i"]).withColumn("_g", F.struct(key, "topic"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _weighed(b.column(2))
            m, count = max(1, len(w.names)), b.num_rows
            terms, at = np.unique(w.doc[w.sentence] * m + w.term, return_inverse=True)
            whole = np.bincount(terms // m, np.bincount(at, w.weight, minlength=len(terms)) ** 2, minlength=count)
            filled = np.bincount(w.doc[np.unique(w.sentence)], minlength=count)
            n = np.bincount(w.doc, minlength=count)
            value = np.where(n < 2, 1.0, (whole - filled) / np.maximum(1, n * (n - 1)))
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(n), pa.array(value)], [key, "topic", "n", "coherence"])

    by = by_document(own, (), "_g")
    made = arrow_rows(by, rows, StructType([own.schema[key], own.schema["topic"], *StructType.fromDDL("n long, coherence double")]))
    return made.withColumn("coherence", F.round("coherence", 6) + 0.0)


def topic_weights(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, topic, sentences, weight (share of the document's sentences)."""
    by = labels.groupBy(key, "topic").agg(F.count("*").alias("sentences"))
    return by.withColumn("weight", F.round(F.col("sentences") / F.sum("sentences").over(Window.partitionBy(key)), 6))


def topic_keywords(sentences: DataFrame, labels: DataFrame, ranked: int = 10, kept: int = 5, least: float = 0.1, key: str = "doc_id") -> DataFrame:
    """key, topic, place, term: of a topic's `ranked` terms of the largest mean weight those over `least`, `kept` at most."""
    own = sentences.join(labels, [key, "i"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _weighed(b.column(2))
            topics = b.column(3).flatten().dictionary_encode()
            k, m = max(1, len(topics.dictionary)), max(1, len(w.names))
            group = w.doc * k + topics.indices.to_numpy(zero_copy_only=False)
            groups, of, n = np.unique(group, return_inverse=True, return_counts=True)
            pairs, at = np.unique(of[w.sentence] * m + w.term, return_inverse=True)
            g, mean = pairs // m, np.bincount(at, w.weight, minlength=len(pairs)) / n[pairs // m]
            over = np.flatnonzero(mean > least - 1e-6)  # terms of a smaller mean stand behind these, so no place changes
            g = g[over]
            yield from _sliced([b.column(0).take(pa.array(groups[g] // k)), topics.dictionary.take(pa.array(groups[g] % k)), w.names.take(pa.array(pairs[over] % m)), mean[over]], [key, "topic", "term", "mean"])

    by = by_document(own, (), key, "topic")
    means = arrow_rows(by, rows, StructType([own.schema[key], own.schema["topic"], *StructType.fromDDL("term string, mean double")])).withColumn("mean", F.round("mean", 9))
    place = F.row_number().over(Window.partitionBy(key, "topic").orderBy(F.desc("mean"), "term")).cast("long")
    out = means.withColumn("place", place).filter((F.col("place") <= min(ranked, kept)) & (F.col("mean") > least))
    return out.select(key, "topic", "place", "term", F.round("mean", 6).alias("mean"))


def similarity_breaks(sentences: DataFrame, threshold: float = 0.7, weight: float = 0.3, key: str = "doc_id") -> DataFrame:
    """key, position, kind, confidence: before sentences whose TF-IDF cosine with the one before is under the threshold,
    in documents of three sentences or more."""
    full = neighbours(sentences, key).filter("n >= 3").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return full.filter(F.col("sim") < threshold).select(key, (F.col("i") + 1).alias("position"), F.lit("semantic_break").alias("kind"), F.round((1 - F.col("sim")) * weight, 9).alias("confidence"))


def topic_breaks(labels: DataFrame, coherence: DataFrame, weight: float = 0.4, key: str = "doc_id") -> DataFrame:
    """As similarity_breaks, where the topic changes: the mean coherence of both topics."""
    nxt = F.lead("topic").over(order(key))
    moved = labels.select(key, "i", "topic", nxt.alias("next")).filter(F.col("next") != F.col("topic"))
    c = coherence.select(key, "topic", "coherence")
    out = moved.join(c, [key, "topic"]).join(c.select(key, F.col("topic").alias("next"), F.col("coherence").alias("other")), [key, "next"])
    return out.select(key, (F.col("i") + 1).alias("position"), F.lit("topic_shift").alias("kind"), F.round((F.col("coherence") + F.col("other")) / 2 * weight, 9).alias("confidence"))


def sentence_spans(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, start, stop: places of the sentences in the text that joins them by single spaces."""
    before = F.coalesce(F.sum(F.length("sentence") + 1).over(order(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sentences.select(key, "i", before.alias("start"), (before + F.length("sentence")).alias("stop"))


def entity_sentences(entities: DataFrame, spans: DataFrame, width: int = 512, key: str = "doc_id") -> DataFrame:
    """Range join of entities (key, start, stop, label) to the sentence that holds them whole. Both sides are dealt into
    stretches of `width` characters, so each entity meets the sentences of its stretch and not those of a whole text."""
    s = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("stop") - 1) / width))))
    e = entities.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("stop").alias("_z"), "label", F.floor(F.col("start") / width).alias("_b"))
    met = s.join(e, (F.col(key) == F.col("_k")) & (F.col("bin") == F.col("_b")) & (F.col("_a") >= F.col("start")) & (F.col("_z") <= F.col("stop")))
    return met.select(key, "i", F.col("_a").alias("start"), F.col("_z").alias("stop"), "label")


def entity_breaks(found: DataFrame, sentences: DataFrame, weight: float = 0.3, key: str = "doc_id") -> DataFrame:
    """As similarity_breaks, where neighbours have less than half of their entities' labels in common."""
    labels = found.groupBy(key, "i").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    own = sentences.select(key, "i").join(labels, [key, "i"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    pair = own.withColumn("next", F.lead("labels").over(order(key))).filter(F.col("next").isNotNull() & ((F.size("labels") > 0) | (F.size("next") > 0)))
    alike = F.size(F.array_intersect("labels", "next")) / F.size(F.array_union("labels", "next"))
    return pair.withColumn("a", alike).filter(F.col("a") < 0.5).select(key, (F.col("i") + 1).alias("position"), F.lit("entity_boundary").alias("kind"), F.round((1 - F.col("a")) * weight, 9).alias("confidence"))


def confident(breaks: DataFrame, least: float = 0.5) -> DataFrame:
    return breaks.filter(F.col("confidence") >= least)


def word_entities(docs: DataFrame, patterns: dict[str, str], text: str, key: str = "doc_id") -> DataFrame:
    """key, start, stop, label: words (runs without white space) that match a pattern, the first of several patterns; a
    recogniser without a model. Spans are in the text with single spaces."""
    w = F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))
    each = docs.select(key, F.posexplode(w).alias("p", "word"))
    start = F.coalesce(F.sum(F.length("word") + 1).over(Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    label: Column = F.coalesce(*(F.when(F.col("word").rlike(p), F.lit(name)) for name, p in patterns.items()))
    return each.select(key, start.alias("start"), (start + F.length("word")).alias("stop"), label.alias("label")).filter(F.col("label").isNotNull())


def context_scores(chunks: DataFrame, least: int = 500, target: int = 2000, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, context (1 from the target on or for one sentence, .8 from the least size on, else .6) and
    closing (mean of 1 and whether the chunk ends in a stop, else .5). chunks: with a column sentences."""
    c = F.regexp_replace("content", r"\s+\z", "")
    n = F.length("content") - F.col("sentences") + 1
    context = F.when((F.col("sentences") <= 1) | (n >= target), 1.0).when(n >= least, 0.8).otherwise(0.6)
    return chunks.select(key, "chunk_index", context.alias("context"), ((F.when(c.rlike(r"[.!?:;]\z"), 1.0).otherwise(0.5) + 1.0) / 2).alias("closing"))


def fingerprint(chunks: DataFrame, terms: int = 50, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, term, weight: unit-length weights of a chunk's commonest terms (first by name of equals)."""
    each = chunks.select(key, "chunk_index", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    n = each.groupBy(key, "chunk_index", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "chunk_index")
    top = n.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "term"))).filter(F.col("place") <= terms)
    return top.select(key, "chunk_index", "term", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(w)), 6).alias("weight"))
