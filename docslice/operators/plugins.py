"""Chunkers of the plug-in kind: sections by patterns, sentences by sentiment, chunks of balanced length.

Splitting and grouping are column expressions where no state is carried; balanced length is a fold over sentences.
Null and empty texts give no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.operators.closed import exploded
from docslice.operators.kernel import chunk_rows, spread

#: Patterns at which sections end, applied one after another, and the two word lists.
PATTERNS = (r"(?ms)^#{1,6}\s+.*$", r"\n\n+", r"\n\s*[-*+]\s+", r"\d+\.\s+")
POSITIVE = "good great excellent amazing wonderful fantastic love like enjoy happy pleased satisfied perfect best awesome brilliant outstanding superb".split()
NEGATIVE = "bad terrible awful horrible hate dislike angry sad disappointed frustrated annoyed worst failed problem issue error wrong broken difficult".split()
STOPS = r"[.!?]+"
WORDS = r"[\p{L}\p{N}_]+"


def sections(c: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """Stripped parts that are left when each pattern in turn splits all parts; a pattern that leaves none is skipped."""
    now = F.array(c)
    for p in patterns:
        split = T.kept(F.flatten(F.transform(now, _by(p))))
        now = F.when(F.size(split) > 0, split).otherwise(now)
    return now


def _by(pattern: str):
    """A splitter of one parameter: of a function with two, the second would be given an element's index."""
    return lambda x: F.split(x, pattern)


def _within(part: str, most: int) -> Iterator[str]:
    """Packs of a long part's sentences, of about `most` characters."""
    held: list[str] = []
    for s in filter(None, map(str.strip, re.split(STOPS, part))):
        if held and sum(map(len, held)) + len(s) > most:
            yield ". ".join(held) + "."
            held = []
        held.append(s)
    if held:
        yield ". ".join(held) + "."


def _sized(parts: list[str], least: int, most: int) -> Iterator[str]:
    for p in parts:
        if len(p) > most:
            yield from _within(p, most)
        elif len(p) >= least:
            yield p


def pattern_sections(df: DataFrame, patterns: tuple[str, ...] = PATTERNS, least: int = 50, most: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    parts = spread(df.select(key, text)).select(key, sections(T.filled(F.col(text)), patterns).alias("parts"))
    return chunk_rows(parts, partial(_sized, least=least, most=most), ["parts"], key=key)


def sentiment(sentence: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative words) / words of a sentence."""
    w = F.regexp_extract_all(F.lower(sentence), F.lit(WORDS), F.lit(0))
    among = lambda known: F.size(F.filter(w, lambda x: x.isin(known)))
    return F.when(F.size(w) > 0, (among(positive) - among(negative)) / F.size(w)).otherwise(0.0)


def sentiment_groups(df: DataFrame, threshold: float = 0.3, least: int = 2, positive: list[str] | None = None, negative: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sentences of a text by polarity: positive ones, negative ones, the others, a chunk each. A text of at most
    `least` sentences is one chunk."""
    c = T.filled(F.col(text))
    own = df.select(key, c.alias("c"), T.kept(F.split(c, STOPS)).alias("s"))
    scored = own.withColumn("scored", F.transform("s", lambda x: F.struct(x.alias("s"), sentiment(x, positive or POSITIVE, negative or NEGATIVE).alias("v"))))
    joined = lambda keep: F.array_join(F.transform(F.filter("scored", keep), lambda x: x["s"]), " ")
    groups = F.array(joined(lambda x: x["v"] > threshold), joined(lambda x: x["v"] < -threshold), joined(lambda x: F.abs(x["v"]) <= threshold))
    chunks = F.when(F.size("s") <= least, F.array(T.strip(F.col("c")))).otherwise(groups)
    return exploded(scored, F.filter(chunks, lambda x: x != ""), key)


def greedy(sizes: list[int], low: int, least: int, most: int) -> list[int]:
    """Ends of runs: a run closes when it reaches `low`, or before it would pass `most`; a last run of one short unit
    joins the run before."""
    ends, total, begun = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > begun:
            ends.append(i)
            total, begun = n, i
            continue
        total += n
        if total >= low:
            ends.append(i + 1)
            total, begun = 0, i + 1
    if begun < len(sizes):
        if ends and len(sizes) - begun == 1 and total < least:
            ends.pop()
        ends.append(len(sizes))
    return ends


def nearest(sizes: list[int], target: int, least: int, most: int) -> list[int] | None:
    """Ends of runs whose sizes are nearest to the target in sum, each within [least, most]; None if there are none.
    Sums grow, so the places where a run may begin are one stretch of the ends before."""
    upto = [0, *accumulate(sizes)]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for i in range(1, len(upto)):
        a, z = bisect_left(upto, upto[i] - most), min(i, bisect_right(upto, upto[i] - least))
        best.append(min(((best[j][0] + abs(upto[i] - upto[j] - target), j) for j in range(a, z)), default=(float("inf"), -1)))
    if best[-1][0] == float("inf"):
        return None
    ends, i = [], len(sizes)
    while i:
        ends.append(i)
        i = best[i][1]
    return ends[::-1]


def _balanced(text: str | None, target: int, tolerance: float, least: int, most: int, method: str) -> Iterator[str]:
    spans = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())) for m in re.finditer(r"[^.!?]+", text or "") if m[0].strip()]
    if not spans:
        if text:
            yield text
        return
    sizes = [z - a for a, z in spans]
    # a text that no cuts fit is cut greedily, so that none is lost
    ends = nearest(sizes, target, least, most) if method == "nearest" or (method == "adaptive" and len(spans) < 500) else None
    begun = 0
    for e in ends or greedy(sizes, int(target * (1 - tolerance)), least, most):
        yield text[spans[begun][0] : spans[e - 1][1]]
        begun = e


def balanced_length(df: DataFrame, target: int = 1000, tolerance: float = 0.3, least: int = 200, most: int = 2000, method: str = "adaptive", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Runs of sentences near a target length. method: greedy, nearest (least sum of deviations) or adaptive (the
    latter for texts of under 500 sentences)."""
    return chunk_rows(df, partial(_balanced, target=target, tolerance=tolerance, least=least, most=most, method=method), [text], key=key)
