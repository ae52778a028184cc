"""Operators on chunk tables (doc_id, chunk_index, content, size): filters, merges, duplicates, enrichment, quality,
validation. Aggregates are partial before they shuffle; neighbours come from windows over a document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.functions import text as T
from docslice.operators.kernel import chunk_rows

LETTERS = r"[\p{L}\p{N}]"
WORDS = r"[\p{L}\p{N}_]+"


def order(key: str = "doc_id"):
    return Window.partitionBy(key).orderBy("chunk_index")


def keep_sizes(chunks: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    ok = F.lit(True)
    if least is not None:
        ok &= F.col("size") >= least
    if most is not None:
        ok &= F.col("size") <= most
    return chunks.filter(ok)


def remove_empty(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("content").rlike(r"\S"))


def transform(chunks: DataFrame, change) -> DataFrame:
    """change: from a content column to a column; where it gives null the content stays."""
    out = chunks.withColumn("content", F.coalesce(change(F.col("content")), F.col("content")))
    return out.withColumn("size", F.length("content").cast("long"))


def enrich(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    c = F.col("content")
    n = F.length(c)
    w = T.words(c)
    return chunks.withColumns(
        {
            "total_chunks": F.count("*").over(Window.partitionBy(key)),
            "word_count": F.size(w).cast("long"),
            "sentence_count": F.size(F.filter(F.split(c, r"\."), lambda x: x.rlike(r"\S"))).cast("long"),
            "avg_word_length": F.round(F.when(F.size(w) > 0, F.length(F.regexp_replace(c, r"\s", "")) / F.size(w)).otherwise(0.0), 6),
            "density": F.round(F.when(n > 0, F.length(F.replace(c, F.lit(" "), F.lit(""))) / n).otherwise(0.0), 6),
            "meaningful": F.length(T.strip(c)) > 10,
        }
    )


def _by_document(chunks: DataFrame, key: str) -> DataFrame:
    """One row for each document, its chunks in order. A document's chunks fit where the document did."""
    return chunks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("units"))


def merged(units: list[str], least: int, most: int, sep: str) -> Iterator[str]:
    """Neighbours of which one is short join while both fit in `most`."""
    now = None
    for u in units:
        if now is None:
            now = u
        elif (len(now) < least or len(u) < least) and len(now) + len(u) <= most:
            now = f"{now}{sep}{u}"
        else:
            yield now
            now = u
    if now is not None:
        yield now


def merge_short(chunks: DataFrame, least: int = 100, most: int = 1000, sep: str = " ", key: str = "doc_id") -> DataFrame:
    return chunk_rows(_by_document(chunks, key), partial(merged, least=least, most=most, sep=sep), ["units"], key=key)


def distinct_units(units: list[str], threshold: float) -> Iterator[str]:
    """Units whose word sets have no Jaccard similarity of `threshold` with a unit kept before. Only kept units that
    share one of the rarest words of the set that a match must share are compared (prefix filter)."""
    sets = [frozenset(u.lower().strip().split()) for u in units]
    seen: dict[str, int] = {}
    for s in sets:
        for w in s:
            seen[w] = seen.get(w, 0) + 1
    index: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        if not s:
            yield units[i]
            continue
        ranked = sorted(s, key=lambda w: (seen[w], w))
        prefix = ranked[: len(s) - int(-(-threshold * len(s) // 1)) + 1]
        near = {j for w in prefix for j in index.get(w, ())}
        if any(len(s & sets[j]) >= threshold * len(s | sets[j]) for j in near):
            continue
        for w in prefix:
            index.setdefault(w, []).append(i)
        yield units[i]


def drop_similar(chunks: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    return chunk_rows(_by_document(chunks, key), partial(distinct_units, threshold=threshold), ["units"], key=key)


def drop_equal(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Over all documents: of chunks of equal content the first by (key, chunk_index) stays. The group-by keeps one
    place for each content in a task, so a content that a third of all chunks have does not gather in one."""
    digest = F.sha2("content", 256)
    first = chunks.groupBy(digest.alias("digest")).agg(F.min(F.struct(key, "chunk_index")).alias("first"))
    return first.select(F.col(f"first.{key}").alias(key), F.col("first.chunk_index").alias("chunk_index"), "digest")


def result_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.stddev_pop("size"), 6).alias("std_size"), F.min("size").alias("least"), F.max("size").alias("most"))


# quality -----------------------------------------------------------------------------------------------------------


def size_consistency(size: Column) -> Column:
    n = F.count(size)
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.stddev_samp(size) / F.avg(size), F.lit(0.0)) / 0.5))


def coherence(c: Column) -> Column:
    """Of a stripped chunk."""
    score = F.when(c.rlike(r"[.!?]\z"), 0.3).otherwise(0.0) + 0.2 + F.when(c.rlike(r"[.!?]"), 0.2).otherwise(0.0)
    score += F.when(F.lower(c).rlike("and|but|however|therefore|thus|also"), 0.1).otherwise(0.0)
    score += F.when(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) < F.length(c) / 50, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def density(c: Column) -> Column:
    w = F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))
    share = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)
    full = 0.4 * T.count(c, LETTERS) / F.length(c) + 0.4 * share + 0.2 * F.least(F.lit(1.0), F.length(c) / 50)
    return F.when(F.length(c) == 0, 0.0).otherwise(full)


def validity(c: Column) -> Column:
    n = F.length(c)
    return F.greatest(F.lit(0.0), 1.0 - F.when(n == 0, 0.5).otherwise(0.0) - F.when(n < 5, 0.3).otherwise(0.0) - F.when(n > 10000, 0.2).otherwise(0.0))


def seam(c: Column, following: Column) -> Column:
    """Quality of the boundary between two stripped chunks."""
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    score = F.when(c.rlike(r"[.!?]\z"), 0.4).otherwise(0.0) + F.when(following.rlike(r"^\p{Lu}"), 0.3).otherwise(0.0) - F.when(c.endswith("-"), 0.2).otherwise(0.0) - F.when(quotes % 2 == 1, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def characters(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\S"), F.lit(0)))


def longest_common(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common substring, known to be `least` or more. Hashed substrings of one length tell whether
    there is one; lengths are first tried in growing steps, so that short ones cost little, then halved."""

    def there(n: int) -> bool:
        if n > min(len(a), len(b)):
            return False
        have = {a[i : i + n] for i in range(len(a) - n + 1)}
        return any(b[i : i + n] in have for i in range(len(b) - n + 1))

    lo, step = least, 1
    while there(lo + step):
        lo, step = lo + step, step * 2
    hi = lo + step - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if there(mid) else (lo, mid - 1)
    return lo


def _grams(units: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `least` characters of the units, and where each unit's begin (runs across units are out)."""
    codes = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) for u in units]
    code = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    n = max(0, len(code) - least + 1)
    h = np.zeros(n, np.uint64)
    for k in range(least):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (code[k : k + n] ^ np.uint64(0x5DEECE66D))
    h ^= h >> np.uint64(29)
    whole = [max(0, len(c) - least + 1) for c in codes]
    places = np.cumsum([0, *map(len, codes)])
    return np.concatenate([h[at : at + w] for at, w in zip(places, whole, strict=False)] or [h]), np.cumsum([0, *whole])


def _pairs_that_meet(grams: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of units with an equal hash, each once; those of places that lie next to one another by hash come first."""
    n = len(starts) - 1
    order = np.argsort(grams, kind="stable")
    h, u = grams[order], np.repeat(np.arange(n), np.diff(starts))[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    h, u = h[new], u[new]
    seen: set[int] = set()
    at, k = np.arange(len(h)), 1
    while len(at := at[at + k < len(h)]) and len(at := at[h[at] == h[at + k]]):
        for pair in np.unique(u[at] * n + u[at + k]).tolist():
            if pair not in seen:
                seen.add(pair)
                yield divmod(pair, n)
        k += 1


def _longest_run(a: np.ndarray, b: np.ndarray, least: int, most: int = 200_000) -> tuple[int, int, int] | None:
    """Length and places of the longest run of equal hashes, in characters; None where more than `most` pairs meet."""
    order = np.argsort(a, kind="stable")
    own = a[order]
    first, last = np.searchsorted(own, b), np.searchsorted(own, b, "right")
    many = last - first
    total = int(many.sum())
    if not total or total > most:
        return (0, 0, 0) if not total else None
    q = np.repeat(np.arange(len(b)), many)
    p = order[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
    by = np.lexsort((p, q - p))
    p, q = p[by], q[by]
    broken = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
    begun = np.concatenate([[0], broken])
    runs = np.diff(np.concatenate([begun, [total]]))
    k = int(runs.argmax())
    return int(runs[k]) + least - 1, int(p[begun[k]]), int(q[begun[k]])


def _overlap(units: list[str], least: int = 11) -> Iterator[tuple]:
    """Pairs that share no run of `least` characters add nothing; only the others are measured. From a fifth of all
    characters on the value is 1 whatever follows, so that a text measures no more pairs than it has characters for."""
    grams, starts = _grams(units, least)
    total, shared = sum(map(len, units)), 0
    for a, b in _pairs_that_meet(grams, starts):
        x, y = units[a], units[b]
        found = _longest_run(grams[starts[a] : starts[a + 1]], grams[starts[b] : starts[b + 1]], least)
        n, p, q = found or (0, 0, 0)
        # unequal characters may have equal hashes, never the reverse
        if found is None or x[p : p + n] != y[q : q + n]:
            n = longest_common(x, y)
        shared += n if n >= least else 0
        if shared / total / 0.2 >= 1:
            break
    ratio = shared / total if total else 0.0
    yield "", 1 - max(0.0, 1 - ratio / 0.2)


def overlap_ratio(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shared characters of a document's chunks, pair by pair (the measure's own definition; a document at a time)."""
    return chunk_rows(_by_document(chunks, key), _overlap, ["units"], "overlap double", key).select(key, F.round("overlap", 6).alias("overlap"))


def quality(chunks: DataFrame, originals: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The metrics of each document's chunks but overlap, and their weighted sum."""
    c = T.strip(F.col("content"))
    own = chunks.select(key, "chunk_index", "size", c.alias("c")).withColumn("next", F.lead("c").over(order(key)))
    scored = own.select(key, "size", coherence(F.col("c")).alias("co"), density(F.col("c")).alias("de"), validity(F.col("c")).alias("va"), F.when(F.col("next").isNotNull(), seam(F.col("c"), F.col("next"))).alias("se"), (F.length("c") < 5).cast("int").alias("empty"), characters(F.col("c")).alias("chars"))
    by = scored.groupBy(key).agg(
        size_consistency(F.col("size")).alias("size_consistency"),
        F.avg("co").alias("coherence"),
        F.avg("de").alias("density"),
        F.avg("va").alias("validation"),
        F.coalesce(F.avg("se"), F.lit(1.0)).alias("boundary"),
        F.avg("empty").alias("empty_ratio"),
        F.array_distinct(F.flatten(F.collect_set("chars"))).alias("chars"),
    )
    full = by.join(originals.select(F.col(key), characters(T.filled(F.col(text))).alias("all")), key)
    covered = F.when(F.size("all") > 0, F.size(F.array_intersect("chars", "all")) / F.size("all")).otherwise(1.0)
    full = full.withColumn("coverage", covered)
    total = 0.15 * F.col("size_consistency") + 0.25 * F.col("coherence") + 0.2 * F.col("coverage") + 0.2 * F.col("boundary") + 0.15 * F.col("density") + 0.05 * F.col("validation")
    full = full.withColumn("overall", F.greatest(F.lit(0.0), total - F.when(F.col("empty_ratio") > 0.1, 0.5 * F.col("empty_ratio")).otherwise(0.0)))
    names = ("size_consistency", "coherence", "coverage", "boundary", "density", "validation", "empty_ratio", "overall")
    return full.select(key, *(F.round(n, 6).alias(n) for n in names))


def recommendations(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    told = F.concat_ws(
        ",",
        F.when(F.col("size_consistency") < 0.7, F.lit("even_sizes")),
        F.when(F.col("coherence") < 0.6, F.lit("keep_sentences")),
        F.when(F.col("boundary") < 0.6, F.lit("better_boundaries")),
        F.when(F.col("density") < 0.5, F.lit("drop_filler")),
        F.when(F.col("empty_ratio") > 0.1, F.lit("drop_empty")),
    )
    return scores.select(key, told.alias("advice"))


# validation --------------------------------------------------------------------------------------------------------


def span_issues(chunks: DataFrame, key: str = "doc_id", start: str = "start", length: str = "size") -> DataFrame:
    """Gaps and overlaps between neighbouring spans, and chunks out of order."""
    w = order(key)
    end = F.col(start) + F.col(length)
    nxt = F.lead(start).over(w)
    return chunks.select(key, "chunk_index", (nxt - end).alias("gap"), (F.lag(start).over(w) > F.col(start)).alias("disordered")).filter((F.col("gap") != 0) | F.col("disordered"))


def chunk_issues(chunks: DataFrame, least: int = 5, most: int = 10000, key: str = "doc_id") -> DataFrame:
    c = F.col("content")
    told = F.concat_ws(",", F.when(~c.rlike(r"\S") | c.isNull(), F.lit("empty")), F.when(F.length(c) < least, F.lit("short")), F.when(F.length(c) > most, F.lit("long")), F.when(F.col(key).isNull(), F.lit("no_source")))
    return chunks.select(key, "chunk_index", told.alias("issues")).filter("issues <> ''")


def missing_parents(chunks: DataFrame, own: str = "path", parent: str = "parent_path", key: str = "doc_id") -> DataFrame:
    """Chunks that name a parent that does not exist."""
    there = chunks.select(F.col(key).alias("k"), F.col(own).alias("p"))
    return chunks.filter(F.col(parent).isNotNull()).join(there, (F.col(key) == F.col("k")) & (F.col(parent) == F.col("p")), "left_anti")


def repeated_ids(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key, "chunk_index").agg(F.count("*").alias("times")).filter("times > 1")
