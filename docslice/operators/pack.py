"""Chunkers that pack units greedily: what comes next depends on the last cut, so each text is folded by a kernel.

The splitters are column expressions; only the units' folding runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.operators.kernel import chunk_rows


def greedy(units: list[str] | None, sep: str, max_units: int | None, max_chars: int, min_units: int = 1, overlap: int = 0) -> Iterator[str]:
    """Up to max_units units while their characters (without separators) stay in max_chars, at least min_units; the
    next chunk starts `overlap` units back, and always beyond the start of this one."""
    units = units or []
    i, n = 0, len(units)
    while i < n:
        j, size = i, 0
        while j < n and (max_units is None or j - i < max_units):
            if j > i and size + len(units[j]) > max_chars:
                break
            size += len(units[j])
            j += 1
        j = min(n, max(j, i + min_units))
        yield sep.join(units[i:j])
        if j >= n:
            return
        i = max(i + 1, j - min(overlap, j - i))


def joined(units: list[str] | None, sep: str, max_chars: int, max_units: int | None = None) -> Iterator[str]:
    """Units joined while the chunk's text so far and the next unit stay in max_chars."""
    now, count = "", 0
    for u in units or []:
        if now and ((max_units and count >= max_units) or len(now) + len(u) > max_chars):
            yield now
            now, count = u, 1
        else:
            now, count = f"{now}{sep}{u}" if now else u, count + 1
    if now:
        yield now


def _packed(df: DataFrame, units, fold, key: str) -> DataFrame:
    return chunk_rows(df.select(F.col(key), units.alias("units")), fold, ["units"], key=key)


def sentence_based(df: DataFrame, max_sentences: int = 5, min_sentences: int = 1, overlap: int = 0, max_chars: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    if max_sentences < min_sentences or min_sentences < 1 or overlap < 0:
        raise ValueError("sentences must fit: 1 <= min <= max, overlap >= 0")
    return _packed(df, T.sentences_or_fallback(T.filled(F.col(text))), partial(greedy, sep=" ", max_units=max_sentences, max_chars=max_chars, min_units=min_sentences, overlap=overlap), key)


def merge_short(paragraphs: list[str] | None, shortest: int) -> list[str]:
    """Short paragraphs join the one before; a long one always closes it."""
    out: list[str] = []
    now = ""
    for p in paragraphs or []:
        if len(p) < shortest:
            now = f"{now}\n\n{p}" if now else p
        else:
            if now:
                out.append(now)
            now = p
    if now:
        out.append(now)
    return out


def paragraph_units(df: DataFrame, shortest: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df.select(F.col(key), T.paragraphs(T.filled(F.col(text))).alias("units")), partial(merge_short, shortest=shortest), ["units"], key=key)


def _paragraphs(units: list[str] | None, shortest: int, max_units: int, max_chars: int, overlap: int) -> Iterator[str]:
    return greedy(merge_short(units, shortest) if shortest else units, "\n\n", max_units, max_chars, 1, overlap)


def paragraph_based(df: DataFrame, max_paragraphs: int = 3, overlap: int = 0, max_chars: int = 3000, merge_below: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _packed(df, T.paragraphs(T.filled(F.col(text))), partial(_paragraphs, shortest=merge_below, max_units=max_paragraphs, max_chars=max_chars, overlap=overlap), key)


def universal_sentence(df: DataFrame, max_chars: int = 1000, max_sentences: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _packed(df, T.sentences_after_stop(T.filled(F.col(text))), partial(joined, sep=" ", max_chars=max_chars, max_units=max_sentences), key)


def universal_paragraph(df: DataFrame, max_chars: int = 2000, max_paragraphs: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _packed(df, T.kept(F.split(T.filled(F.col(text)), r"\n\s*\n")), partial(joined, sep="\n\n", max_chars=max_chars, max_units=max_paragraphs), key)


def _tail(text: str, overlap: int) -> str:
    return text[-overlap:] if overlap else ""


def structured_pack(units: list[str] | None, max_chars: int, overlap: int) -> Iterator[str]:
    """Paragraphs packed to max_chars; a chunk starts with the last `overlap` characters of the one before."""
    now = ""
    for u in units or []:
        if now and len(now) + len(u) + 2 > max_chars:
            yield now
            head = _tail(now, overlap)
            now = f"{head}\n\n{u}" if head else u
        else:
            now = f"{now}\n\n{u}" if now else u
    if now:
        yield now


def universal_document(df: DataFrame, max_chars: int = 1000, overlap: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _packed(df, T.kept(F.split(T.filled(F.col(text)), r"\n\s*\n")), partial(structured_pack, max_chars=max_chars, overlap=overlap), key)


def last_space_windows(text: str | None, size: int, overlap: int) -> Iterator[str]:
    """Windows of characters that end at the last space if it lies past half of the window."""
    text = text or ""
    a, n = 0, len(text)
    while a < n:
        z = min(a + size, n)
        if z < n and (cut := text.rfind(" ", a, z)) > a + size // 2:
            z = cut
        if piece := text[a:z].strip():
            yield piece
        if z >= n:
            return
        a = max(a + 1, z - overlap)


def text_windows(df: DataFrame, size: int = 1000, overlap: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(last_space_windows, size=size, overlap=overlap), [text], key=key)


def space_windows(text: str | None, window: int, step: int, shortest: int, preserve: bool) -> Iterator[str]:
    """Overlapping windows of characters whose ends and next starts move on to white space."""
    text = text or ""
    gap = re.compile(r"[ \t\n\r]")
    n, at, first = len(text), 0, True
    if not text.strip():
        return

    def onward(p: int) -> int:
        if not preserve or p <= 0 or p >= n:
            return min(max(p, 0), n)
        m = gap.search(text, p)
        return m.start() if m else n

    while at < n:
        end = onward(at + window)
        if end - at < shortest and not first:
            return
        yield text[at:end]
        first = False
        at = max(at + 1, onward(at + step))


def character_windows(df: DataFrame, window: int = 1000, step: int = 500, min_window: int = 1, preserve_boundaries: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(space_windows, window=window, step=step, shortest=min_window, preserve=preserve_boundaries), [text], key=key)


# recursive: paragraphs, then sentences, then fixed slices, each level inside the chunks of the one above

LEVELS = (("paragraph", 1200, 2500), ("sentence", 400, 800), ("fixed", 200, 300))


def recursive_quality(text: str, target: int, longest: int) -> float:
    size = min(1.0, len(text) / target) * (0.5 if len(text) > longest else 1.0)
    return 0.4 * size + 0.4 * min(1.0, len(text.split(". ")) / 5) + 0.2 * (1.0 if text.rstrip().endswith((".", "!", "?")) else 0.8)


def _level(text: str, kind: str, target: int, longest: int) -> list[str]:
    if kind == "paragraph":
        return list(joined([p for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p], "\n\n", target))
    if kind == "sentence":
        return list(joined([s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s], " ", target))
    return [text[i : i + target] for i in range(0, len(text), target)]


def recursive_chunks(text: str | None, depth: int, threshold: float) -> Iterator[tuple]:
    """Content, level, path, parent path and quality; children before their parent; chunks under the threshold go
    with all below them."""

    def walk(piece: str, level: int, path: str) -> Iterator[tuple]:
        kind, target, longest = LEVELS[level]
        for i, c in enumerate(_level(piece, kind, target, longest)):
            if not c.strip():
                continue
            quality = recursive_quality(c, target, longest)
            if quality < threshold:
                continue
            own = f"{path}/{i}" if path else str(i)
            if level + 1 < depth and len(c) > LEVELS[level + 1][1]:
                yield from walk(c, level + 1, own)
            yield c, level, own, path or None, quality

    return walk(text or "", 0, "")


def recursive(df: DataFrame, depth: int = 3, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(recursive_chunks, depth=depth, threshold=threshold), [text], "level int, path string, parent_path string, quality double", key)


def recursive_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, mean quality and mean children by level."""
    n = chunks.filter("parent_path is not null").groupBy(F.col(key).alias("k"), F.col("parent_path").alias("p"), (F.col("level") - 1).alias("l")).agg(F.count("*").alias("children"))
    full = chunks.join(n, (F.col(key) == F.col("k")) & (F.col("path") == F.col("p")) & (F.col("level") == F.col("l")), "left")
    return full.groupBy("level").agg(F.count("*").alias("chunks"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg(F.coalesce("children", F.lit(0))), 6).alias("mean_children"))
