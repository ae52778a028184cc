"""Chunks by meaning, on sentences: features, similarity of neighbours, boundaries, and the chunks between them.

Sentences stay rows (doc_id, i, sentence); neighbours come from windows over a document. TF-IDF is fitted on each
document by itself, with smoothed inverse document frequencies and unit length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docslice.functions import text as T
from docslice.operators.kernel import chunk_rows
from docslice.runtime import arrow_rows

WORDS = r"[\p{L}\p{N}_]+"


def order(key: str = "doc_id"):
    return Window.partitionBy(key).orderBy("i")


def sentence_table(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(T.sentences(T.filled(F.col(text)))).alias("i", "sentence")).select(key, F.col("i").cast("long").alias("i"), "sentence")


def surface_features(c: Column) -> list[Column]:
    """Eight counts of a sentence, scaled."""
    n = F.length(c).cast("double")
    words = T.count(c, r"\S+").cast("double")
    return [n / 100, words / 20, T.count(c, "[,;:]") / 5.0, T.count(c, r"\p{Lu}") / 10.0, T.count(c, r"[0-9]") / 10.0, F.when(c.endswith("?"), 1.0).otherwise(0.0), F.when(c.endswith("!"), 1.0).otherwise(0.0), F.when(words > 0, n / words / 10).otherwise(0.0)]


def word_features(c: Column) -> list[Column]:
    w = F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))
    n = F.size(w).cast("double")
    some = lambda x: F.when(n > 0, x).otherwise(0.0)
    return [n, some(F.size(F.array_distinct(w)) / n), some(F.length(F.array_join(w, "")) / n), some(F.size(F.filter(w, lambda x: F.length(x) > 6)) / n), some(F.size(F.filter(w, lambda x: F.length(x) < 4)) / n)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    n = F.size(a)
    if metric == "cosine":
        return F.coalesce(F.greatest(F.lit(0.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))), F.lit(0.0))
    if metric == "dot":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot(a, b) + 1) / 2))
    gap = F.zip_with(a, b, lambda x, y: x - y)
    if metric == "euclidean":
        return 1 - F.least(F.sqrt(dot(gap, gap)) / F.sqrt(n), F.lit(1.0))
    if metric == "manhattan":
        return 1 - F.least(F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.abs(x)) / (2 * n), F.lit(1.0))
    raise ValueError(f"unknown metric {metric}")


def with_vectors(sentences: DataFrame, features=surface_features) -> DataFrame:
    return sentences.withColumn("v", F.array(*features(F.col("sentence"))))


def consecutive(vectors: DataFrame, metric: str = "cosine", key: str = "doc_id") -> DataFrame:
    """doc, i, sim: similarity of sentence i and the next one."""
    staged = vectors.select(key, "i", "v", F.lead("v").over(order(key)).alias("nv")).filter(F.col("nv").isNotNull())
    return staged.select(key, "i", F.round(similarity(F.col("v"), F.col("nv"), metric), 9).alias("sim"))


def by_threshold(sims: DataFrame, threshold: float = 0.7, strong: float = 0.5) -> DataFrame:
    return sims.filter(F.col("sim") < threshold).withColumn("strength", F.when(F.col("sim") < strong, "strong").otherwise("moderate"))


def by_window(sims: DataFrame, width: int = 3, margin: float = 0.1, key: str = "doc_id") -> DataFrame:
    """Similarity under the means of the `width` before and of the `width` from here on, by a margin."""
    left = F.avg("sim").over(order(key).rowsBetween(-width, -1))
    right = F.avg("sim").over(order(key).rowsBetween(0, width - 1))
    out = sims.withColumns({"left": left, "right": right})
    return out.filter((F.col("sim") < F.col("left") - margin) & (F.col("sim") < F.col("right") - margin)).select(key, "i", "sim")


def _spread_of(sims: Column) -> Column:
    """mean and deviation of an array, folded in its order: a similarity often lies right on mean less deviation (always
    for one of two), so the last bit counts. The steps are those of Welford, with the remainder of the new mean."""
    begun = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(z: Column, x: Column) -> Column:
        mean = z["mean"] + (x - z["mean"]) / (z["n"] + 1)
        return F.struct((z["n"] + 1).alias("n"), (z["total"] + x).alias("total"), mean.alias("mean"), (z["squares"] + (x - mean) * (x - z["mean"])).alias("squares"))

    return F.aggregate(sims, begun, step, lambda z: F.struct((z["total"] / z["n"]).alias("m"), F.sqrt(z["squares"] / z["n"]).alias("s")))


def by_spread(sims: DataFrame, least: float = 0.3, key: str = "doc_id") -> DataFrame:
    """Similarity under the document's mean less its deviation; strength in deviations."""
    own = sims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "sim"))).alias("own"))
    of = F.explode(F.array(_spread_of(F.transform("own", lambda x: x["sim"]))))  # a generator: folded once a document
    under = own.select(key, "own", of.alias("of")).select(key, F.col("of.s").alias("s"), F.col("of.m").alias("m"), F.greatest(F.lit(least), F.col("of.m") - F.col("of.s")).alias("bar"), "own")
    out = under.select(key, "m", "s", F.inline(F.filter("own", lambda x: x["sim"] < F.col("bar"))))
    return out.select(key, "i", "sim", F.when(F.col("s") > 0, F.round((F.col("m") - F.col("sim")) / F.col("s"), 6)).otherwise(0.0).alias("strength"))


def by_coherence(sims: DataFrame, width: int = 3, weight: float = 0.3, threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    before = F.coalesce(F.avg("sim").over(order(key).rowsBetween(-width, -1)), F.col("sim"))
    out = sims.withColumn("score", F.round((1 - F.col("sim")) * (1 - weight) + (1 - before) * weight, 9))
    return out.filter(F.col("score") > threshold).select(key, "i", "score")


def adaptive_threshold(sims: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document's threshold: mean less half a deviation if similarities lie close, else less a whole one, in .1-.9."""
    s = F.coalesce(F.stddev_pop("sim"), F.lit(0.0))
    value = F.avg("sim") - F.when(s < 0.1, 0.5 * s).otherwise(s)
    return sims.groupBy(key).agg(F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.1), value)), 6).alias("threshold"))


def segments(sentences: DataFrame, cuts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences joined between boundaries (a boundary i lies after sentence i)."""
    marks = cuts.select(key, (F.col("i") + 1).alias("i"), F.lit(1).alias("cut"))
    out = sentences.join(marks, [key, "i"], "left").withColumn("segment", F.sum(F.coalesce("cut", F.lit(0))).over(order(key)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    return out.groupBy(key, "segment").agg(text.alias("content"), F.count("*").alias("sentences")).select(key, F.col("segment").cast("long").alias("chunk_index"), "content", "sentences")


def bounded(units: list[str], cuts: list[int], least: int, most: int, chars: int) -> Iterator[str]:
    """Chunks between boundaries at least `least` sentences apart; longer runs are split, texts cut at `chars`."""
    start, marks = 0, []
    for c in sorted(set(cuts)):
        if c + 1 - start >= least:
            marks.append(c + 1)
            start = c + 1
    start = 0
    for end in [*marks, len(units)]:
        for a in range(start, end, most):
            yield " ".join(units[a : min(a + most, end)])[:chars]
        start = end


def semantic_chunks(sentences: DataFrame, cuts: DataFrame, least: int = 2, most: int = 15, chars: int = 5000, key: str = "doc_id") -> DataFrame:
    by = sentences.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]).alias("units"))
    marks = cuts.groupBy(key).agg(F.collect_list(F.col("i").cast("int")).alias("cuts"))
    joined = by.join(marks, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    return chunk_rows(joined, partial(bounded, least=least, most=most, chars=chars), ["units", "cuts"], key=key)


# TF-IDF per document -----------------------------------------------------------------------------------------------


def words_of(sentence: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*stop)) if stop else words


@dataclass
class Weights:
    """Unit-length TF-IDF of all sentences of a batch of documents; rows are sorted by sentence and term."""

    doc: np.ndarray  # of each sentence
    sentence: np.ndarray  # of each row
    term: np.ndarray
    weight: np.ndarray
    names: pa.Array


def _places(lists: pa.Array) -> np.ndarray:
    """Which list each element of the flat lists is from; null lists are empty."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))


def _weighed(units: pa.Array, pairs: bool = False, most: int | None = None) -> Weights:
    """units: a list of sentences, each a list of words, for each document. Words become numbers of the batch, so that all
    counts are those of sorted numbers."""
    doc, flat = _places(units), units.flatten()
    sentence, words = _places(flat), flat.flatten().dictionary_encode()
    term, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if pairs and len(term):
        next_ = np.flatnonzero(sentence[1:] == sentence[:-1])
        two, at = np.unique(term[next_] * len(names) + term[next_ + 1], return_inverse=True)
        joined = pc.binary_join_element_wise(names.take(pa.array(two // len(names))), names.take(pa.array(two % len(names))), " ")
        term, sentence, names = np.concatenate([term, at + len(names)]), np.concatenate([sentence, sentence[next_]]), pa.concat_arrays([names, joined])
    m = max(1, len(names))
    keys, tf = np.unique(sentence * m + term, return_counts=True)
    sentence, term = keys // m, keys % m
    own, at, df = np.unique(doc[sentence] * m + term, return_inverse=True, return_counts=True)
    if most is not None and len(own):
        rank = np.empty(m, np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(m)
        by = np.lexsort((rank[own % m], -np.bincount(at, tf), own // m))
        first = np.searchsorted(own // m, own // m)  # own is sorted by document
        place = np.empty(len(own), np.int64)
        place[by] = np.arange(len(own)) - first
        keep = place[at] < most
        sentence, term, tf, at = sentence[keep], term[keep], tf[keep], at[keep]
    n = np.bincount(doc, minlength=1)[doc[sentence]] if len(sentence) else np.zeros(0)
    w = tf * (np.log((1 + n) / (1 + df[at])) + 1)
    norm = np.sqrt(np.bincount(sentence, w * w, minlength=1))
    return Weights(doc, sentence, term, w / norm[sentence] if len(sentence) else w, names)


def by_document(sentences: DataFrame, stop: tuple[str, ...] = (), key: str = "doc_id", *more: str) -> DataFrame:
    """key, and of all its sentences, in order, as lists: i, words (and the columns of `more`)."""
    by = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "sentence", *more))).alias("s"))
    words = F.transform("s.sentence", lambda x: words_of(x, stop))
    return by.select(key, F.col("s.i").alias("i"), words.alias("words"), *(F.col(f"s.{c}").alias(c) for c in more))


def _sliced(columns: list, names: list[str], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    made = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
    for a in range(0, made.num_rows, rows):
        yield made.slice(a, rows)


def tfidf(sentences: DataFrame, pairs: bool = False, most: int | None = None, stop: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """doc, i, term, weight: unit-length TF-IDF of each sentence in its document. The words of a document are gathered
    once, and no term is shuffled. pairs: pairs of words (that follow one another once words of `stop` are out) are terms
    as well; most: only so many of a document's commonest terms (first by name of equals)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _weighed(b.column(2), pairs, most)
            i = b.column(1).flatten().take(pa.array(w.sentence))
            yield from _sliced([b.column(0).take(pa.array(w.doc[w.sentence])), i, w.names.take(pa.array(w.term)), w.weight], [key, "i", "term", "weight"])

    own = by_document(sentences, stop, key)
    return arrow_rows(own, rows, StructType([own.schema[key], *StructType.fromDDL("i long, term string, weight double")]))


def neighbours(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, n (sentences of the document), sim: TF-IDF cosine of sentences i and i + 1; null where they share no term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _weighed(b.column(2))
            i, m, count = b.column(1).flatten().to_numpy(), max(1, len(w.names)), len(w.doc)
            keys = w.sentence * m + w.term
            at = np.minimum(np.searchsorted(keys, keys + m), max(0, len(keys) - 1))
            met = np.flatnonzero(keys[at] == keys + m)
            sims = np.bincount(w.sentence[met], w.weight[met] * w.weight[at[met]], minlength=count)
            shared = np.bincount(w.sentence[met], minlength=count) > 0
            next_ = np.flatnonzero((w.doc[1:] == w.doc[:-1]) & (i[1:] == i[:-1] + 1))
            n = np.bincount(w.doc, minlength=1)[w.doc[next_]]
            yield from _sliced([b.column(0).take(pa.array(w.doc[next_])), i[next_], n, pa.array(sims[next_], mask=~shared[next_])], [key, "i", "n", "sim"])

    own = by_document(sentences, (), key)
    made = arrow_rows(own, rows, StructType([own.schema[key], *StructType.fromDDL("i long, n long, sim double")]))
    return made.withColumn("sim", F.round("sim", 6))


def tfidf_similarity(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc, i, sim of sentences i and i + 1 by any weights: an equi-join on the shared term. See `neighbours` for TF-IDF."""
    a, b = weights.alias("a"), weights.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.i") + 1 == F.col("b.i")))
    return met.groupBy(F.col(f"a.{key}").alias(key), F.col("a.i").alias("i")).agg(F.round(F.sum(F.col("a.weight") * F.col("b.weight")), 6).alias("sim"))


# clusters of a document's sentences --------------------------------------------------------------------------------


def _kmeans(x: np.ndarray, k: int, rounds: int = 20) -> list[int]:
    """Lloyd's rounds from evenly placed first centres."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centres[j] = x[label == j].mean(0)
    return label.tolist()


def _ward(x: np.ndarray, k: int) -> list[int]:
    """Agglomeration by the least growth of squared distances. A chain of nearest neighbours finds all merges (two groups
    that are each other's nearest can merge at once), with a row of distances at a time: memory is that of the vectors."""
    n = len(x)
    mean, size, alive, merges, chain = x.astype(float).copy(), np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        i = chain[-1]
        d = ((mean - mean[i]) ** 2).sum(1) * (size * size[i] / (size + size[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            del chain[-2:]
            merges.append((float(d[j]), i, j))
            mean[j] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
            size[j] += size[i]
            alive[i] = False
        else:
            chain.append(j)
    # the lowest merges give k groups; one that a group takes part in never lies below those that made it
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for _, i, j in sorted(merges, key=lambda m: m[0])[: n - k]:
        parent[root(i)] = root(j)
    return [root(v) for v in range(n)]


def _dbscan(x: np.ndarray, eps: float, least: int) -> list[int]:
    """Density clusters; distances are taken a block of rows, then a row, at a time."""
    reach, n = eps * eps, len(x)
    rows = max(1, (1 << 22) // max(1, x.size))
    many = np.concatenate([(((x[a : a + rows, None] - x[None]) ** 2).sum(2) <= reach).sum(1) for a in range(0, n, rows)])
    core, label, group = many >= least, np.full(n, -1), 0
    for i in range(n):
        if label[i] >= 0 or not core[i]:
            continue
        queue = [i]
        label[i] = group
        while queue:
            new = np.flatnonzero((((x - x[queue.pop()]) ** 2).sum(1) <= reach) & (label < 0))
            label[new] = group
            queue += new[core[new]].tolist()
        group += 1
    return label.tolist()


def cluster_labels(vectors: list[list[float]], method: str, most: int) -> list[int]:
    x = np.array(vectors, float)
    n = len(x)
    if n < 3:
        return [0] * n
    if method == "kmeans":
        return _kmeans(x, min(n, max(2, min(10, n // most))))
    if method == "ward":
        return _ward(x, min(n, max(2, min(8, n // most))))
    return _dbscan(x, 0.5, 2)


def _cluster_chunks(units: list[str], vectors: list[list[float]], method: str, least: int, most: int) -> Iterator[str]:
    label = cluster_labels(vectors, method, most)
    cuts = [i for i in range(len(label) - 1) if label[i] != label[i + 1] or label[i] < 0]
    return bounded(units, cuts, least, most, 10**9)


def cluster_chunks(vectors: DataFrame, method: str = "kmeans", least: int = 2, most: int = 10, key: str = "doc_id") -> DataFrame:
    """Cuts where the cluster of a document's sentences changes (noise cuts always)."""
    by = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "sentence", "v"))).alias("s"))
    by = by.select(key, F.transform("s", lambda x: x["sentence"]).alias("units"), F.transform("s", lambda x: x["v"]).alias("vectors"))
    return chunk_rows(by, partial(_cluster_chunks, method=method, least=least, most=most), ["units", "vectors"], key=key)


# context-enriched packing ------------------------------------------------------------------------------------------


def contextual(units: list[str], cuts: list[int], least: int, target: int, most: int, overlap: int) -> Iterator[str]:
    marks, now, size = set(cuts), [], 0
    for i, s in enumerate(units):
        if now and size + len(s) + 1 > most:
            yield " ".join(now)
            now = _trailing(now, overlap)
            size = len(" ".join(now))
        now.append(s)
        size += len(s) + 1
        if (i in marks and size >= least) or size >= target:
            yield " ".join(now)
            now = _trailing(now, overlap) if i + 1 < len(units) else []
            size = len(" ".join(now))
    if now and (not overlap or " ".join(now) != " ".join(_trailing(units, overlap))):
        yield " ".join(now)


def _trailing(units: list[str], chars: int) -> list[str]:
    out: list[str] = []
    for u in reversed(units):
        if sum(map(len, out)) + len(u) > chars:
            break
        out.insert(0, u)
    return out


def context_enriched(sentences: DataFrame, cuts: DataFrame, least: int = 300, target: int = 1000, most: int = 1500, overlap: int = 100, key: str = "doc_id") -> DataFrame:
    by = sentences.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]).alias("units"))
    marks = cuts.groupBy(key).agg(F.collect_list(F.col("i").cast("int")).alias("cuts"))
    joined = by.join(marks, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    return chunk_rows(joined, partial(contextual, least=least, target=target, most=most, overlap=overlap), ["units", "cuts"], key=key)


def top_words(chunks: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    """The k commonest words of each document's chunks."""
    words = chunks.select(key, F.explode(F.regexp_extract_all(F.lower("content"), F.lit(WORDS), F.lit(0))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    return words.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word")).cast("long")).filter(F.col("place") <= k)


def silence_segments(levels: list[float] | None, step: float, below: float, quiet: float, pad: float, shortest: float, longest: float) -> Iterator[tuple]:
    """Sounding stretches of a level track (dB at each step of seconds): start and end in seconds."""
    runs, start, hush = [], None, 0
    for i, v in enumerate([*(levels or []), *[-1e9] * (int(quiet / step) + 1)]):
        if v >= below:
            start = i if start is None else start
            hush = 0
        elif start is not None:
            hush += 1
            if hush * step >= quiet:
                runs.append([start * step, (i - hush + 1) * step])
                start, hush = None, 0
    total = len(levels or []) * step
    padded: list[list[float]] = []
    for a, z in runs:
        a, z = max(0.0, a - pad), min(total, z + pad)
        if padded and (a <= padded[-1][1] or padded[-1][1] - padded[-1][0] < shortest):
            padded[-1][1] = z
        else:
            padded.append([a, z])
    for a, z in padded:
        n = max(1, math.ceil((z - a) / longest))
        for k in range(n):
            yield "", round(a + (z - a) * k / n, 6), round(a + (z - a) * (k + 1) / n, 6)
