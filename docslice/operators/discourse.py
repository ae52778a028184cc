"""Boundaries by discourse: markers, similarity, shift of topic and kept entities, and the chunks between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docslice.operators.semantic import _places, _sliced, by_document, order
from docslice.runtime import arrow_rows

#: Phrases that mark how a sentence goes on, and their weights.
MARKERS: dict[str, tuple[tuple[str, float], ...]] = {
    "contrast": (("however", 0.9), ("nevertheless", 0.9), ("nonetheless", 0.9), ("on the other hand", 0.9), ("in contrast", 0.9), ("conversely", 0.8), ("yet", 0.7), ("but", 0.6), ("although", 0.6), ("while", 0.5), ("despite", 0.7), ("in spite of", 0.7), ("unlike", 0.6)),
    "continuation": (("furthermore", 0.8), ("moreover", 0.8), ("additionally", 0.8), ("also", 0.5), ("besides", 0.7), ("in addition", 0.8), ("likewise", 0.7), ("similarly", 0.7), ("further", 0.6)),
    "causation": (("therefore", 0.9), ("consequently", 0.9), ("as a result", 0.9), ("thus", 0.8), ("hence", 0.8), ("accordingly", 0.8), ("because of this", 0.8), ("for this reason", 0.8), ("so", 0.6)),
    "sequence": (("first", 0.8), ("second", 0.8), ("third", 0.8), ("next", 0.7), ("then", 0.7), ("after", 0.6), ("finally", 0.9), ("last", 0.8), ("in conclusion", 0.9), ("to conclude", 0.9), ("to sum up", 0.9), ("initially", 0.7), ("subsequently", 0.7)),
    "exemplification": (("for example", 0.7), ("for instance", 0.7), ("such as", 0.6), ("namely", 0.7), ("specifically", 0.7), ("in particular", 0.7), ("e.g.", 0.6), ("i.e.", 0.6)),
    "emphasis": (("indeed", 0.6), ("in fact", 0.7), ("clearly", 0.6), ("obviously", 0.6), ("undoubtedly", 0.6), ("certainly", 0.6), ("importantly", 0.7), ("notably", 0.7)),
    "summary": (("in summary", 0.9), ("to summarize", 0.9), ("overall", 0.8), ("in brief", 0.8), ("in short", 0.8), ("on the whole", 0.8), ("all in all", 0.8), ("generally", 0.6)),
    "comparison": (("similarly", 0.7), ("likewise", 0.7), ("in comparison", 0.8), ("compared to", 0.7), ("in the same way", 0.7), ("by comparison", 0.8)),
    "elaboration": (("specifically", 0.6), ("in particular", 0.6), ("namely", 0.7), ("that is", 0.6), ("that is to say", 0.7), ("in other words", 0.7)),
}


BEFORE = r"(?<![\p{L}\p{N}_])"


def _body(text: str) -> str:
    return text.replace(".", "[.]") + (r"(?=[\p{L}\p{N}_])" if text.endswith(".") else r"(?![\p{L}\p{N}_])")


def phrase(text: str) -> str:
    """Pattern of a phrase between characters that are no part of a word (at its last stop: before such a one)."""
    return BEFORE + _body(text)


def _trie(bodies: dict[str, str]) -> str:
    """One pattern of all phrases by common first letters, so that most words are told from them by one letter. bodies:
    what follows the letters that are left of each."""
    ends = sorted(end for left, end in bodies.items() if not left)
    heads: dict[str, dict[str, str]] = {}
    for left, end in bodies.items():
        if left:
            heads.setdefault(left[0], {})[left[1:]] = end
    return "(?:" + "|".join([*ends, *(("[.]" if c == "." else c) + _trie(own) for c, own in sorted(heads.items()))]) + ")"


def markers(sentences: DataFrame, sensitivity: float = 0.7, table: dict[str, tuple[tuple[str, float], ...]] | None = None, key: str = "doc_id") -> DataFrame:
    """key, i, kind, phrase, strength: all markers of each sentence. A phrase in the first fifth of it counts a fifth
    more, one in a document's first sentence a tenth more; 1 at most."""
    low = F.col("low")
    found = []
    for kind, phrases in (table or MARKERS).items():
        for p, weight in phrases:
            at = F.when(F.contains(low, F.lit(p)), F.regexp_instr(low, F.lit(phrase(p)))).otherwise(0)
            value = weight * F.when((at - 1) / F.col("n") < 0.2, 1.2).otherwise(1.0) * F.when(F.col("i") == 0, 1.1).otherwise(1.0) * sensitivity
            found.append(F.when(at > 0, F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("phrase"), F.round(F.least(F.lit(1.0), value), 6).alias("strength"))))
    any_ = F.lit(BEFORE + _trie({p: _body(p)[len(p.replace(".", "[.]")) :] for own in (table or MARKERS).values() for p, _ in own}))
    # one pattern tells the sentences that have none, which are most; the others are lower-cased once, behind a generator
    own = sentences.select(key, "i", F.lower("sentence").alias("low"), F.length("sentence").alias("n")).filter(F.regexp_like(low, any_))
    each = own.select(F.inline(F.array(F.struct(key, "i", "low", "n")))).select(key, "i", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return each.select(key, "i", "m.*")


def _shifts(units: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sentences of a batch of documents begin a boundary, and 1 less the TF-IDF cosine of the two sentences before
    and after it, as two texts. units: a list of sentences, each a list of words, for each document."""
    doc, flat = _places(units), units.flatten()
    count = len(doc)
    begins = np.ones(count, bool)
    begins[1:] = doc[1:] != doc[:-1]
    words = flat.flatten().dictionary_encode()
    m = max(1, len(words.dictionary))
    keys, tf = np.unique(_places(flat) * m + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    sentence, term = keys // m, keys % m
    parts = []
    for off, side in ((1, 0), (2, 0), (0, 1), (-1, 1)):
        ok = np.flatnonzero((sentence + off >= 0) & (sentence + off < count))
        at = sentence[ok] + off
        same = (doc[at] == doc[sentence[ok]]) & ~begins[at]
        parts.append((at[same] * m + term[ok][same], np.where(side == 0, tf[ok][same], 0), np.where(side == 1, tf[ok][same], 0)))
    names, at = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
    a, z = (np.bincount(at, np.concatenate([p[k] for p in parts]), minlength=len(names)) for k in (1, 2))
    own, term = names // m, names % m
    if len(own) and np.bincount(own).max() > most:
        rank = np.empty(m, np.int64)
        rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(m)
        by = np.lexsort((rank[term], -a - z, own))
        keep = by[np.arange(len(own)) - np.searchsorted(own, own) < most]
        own, a, z = own[keep], a[keep], z[keep]
    alone = math.log(3 / 2) + 1
    total = lambda v: np.bincount(own, v, minlength=count)
    before, after = np.sqrt(total((a * np.where(z > 0, 1.0, alone)) ** 2)), np.sqrt(total((z * np.where(a > 0, 1.0, alone)) ** 2))
    norm = before * after
    value = np.where(norm > 0, 1 - total(a * z) / np.where(norm > 0, norm, 1), np.where(before + after > 0, 1.0, 0.0))
    return np.flatnonzero(~begins), value[~begins]


def topic_shift(sentences: DataFrame, most: int = 100, stop: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """key, i, shift for each sentence but a document's first; `most` commonest terms, without the words of `stop`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, (at, value) = _places(b.column(1)), _shifts(b.column(2), most)
            place = at - np.searchsorted(doc, doc[at])
            yield from _sliced([b.column(0).take(pa.array(doc[at])), place, value], [key, "i", "shift"])

    own = by_document(sentences, stop, key)
    made = arrow_rows(own, rows, StructType([own.schema[key], *StructType.fromDDL("i long, shift double")]))
    return made.withColumn("shift", F.round("shift", 9))


def entity_terms(found: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, entity: -.3 where a sentence shares an entity (lower-cased) with the one before, else .1. found: key, i,
    entity, from any recogniser; without one leave the term out."""
    names = found.groupBy(key, "i").agg(F.collect_set(F.lower("entity")).alias("names"))
    own = sentences.select(key, "i").join(names, [key, "i"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    pair = own.withColumn("before", F.lag("names").over(order(key))).filter(F.col("before").isNotNull())
    return pair.select(key, "i", F.when(F.arrays_overlap("names", "before"), -0.3).otherwise(0.1).alias("entity"))


def boundaries(sentences: DataFrame, cuts: DataFrame, shifts: DataFrame, entities: DataFrame | None = None, weights: tuple[float, float, float] = (0.3, 0.4, 0.2), least: float = 0.6, sensitivity: float = 0.7, key: str = "doc_id", own_markers: DataFrame | None = None) -> DataFrame:
    """key, i, semantic, discourse, topic, entity, score, strength of boundaries before sentence i. cuts: key, i (the
    sentence before), sim of the boundaries found by similarity; the others count as no dissimilarity. own_markers: the sentences' markers, where they are at hand."""
    best = (markers(sentences, sensitivity, key=key) if own_markers is None else own_markers).groupBy(key, "i").agg(F.max("strength").alias("discourse"))
    own = sentences.filter("i > 0").select(key, "i").join(cuts.select(key, (F.col("i") + 1).alias("i"), (1 - F.col("sim")).alias("semantic")), [key, "i"], "left")
    own = own.join(best, [key, "i"], "left").join(shifts.select(key, "i", F.col("shift").alias("topic")), [key, "i"], "left")
    own = own.join(entities, [key, "i"], "left") if entities is not None else own.withColumn("entity", F.lit(0.0))
    parts = {n: F.coalesce(n, F.lit(0.0)) for n in ("semantic", "discourse", "topic", "entity")}
    d, t, e = weights
    score: Column = F.round(parts["semantic"] * (1 - d - t - e) + parts["discourse"] * d + parts["topic"] * t + parts["entity"] * e, 9)
    out = own.select(key, "i", *(F.round(v, 6).alias(n) for n, v in parts.items()), score.alias("score"))
    return out.filter(F.col("score") >= least).withColumn("strength", F.when(F.col("score") > 0.8, "strong").otherwise("moderate"))


def chunks(sentences: DataFrame, found: DataFrame, own_markers: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, content, sentences, score (of the boundary that the chunk begins with) and kinds (of markers in
    its first sentence)."""
    kinds = own_markers.groupBy(key, "i").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    marked = sentences.join(found.select(key, "i", "score"), [key, "i"], "left").join(kinds, [key, "i"], "left")
    runs = marked.withColumn("chunk_index", F.sum(F.col("score").isNotNull().cast("long")).over(order(key)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    made = runs.groupBy(key, "chunk_index").agg(text.alias("content"), F.count("*").alias("sentences"), F.min_by(F.struct("score", "kinds"), "i").alias("first"))
    return made.select(key, "chunk_index", "content", "sentences", F.col("first.score").alias("score"), F.coalesce("first.kinds", F.lit("")).alias("kinds"))
