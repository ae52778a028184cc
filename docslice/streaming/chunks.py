"""Chunks of growing texts with Structured Streaming.

A source's text comes in pieces (source, seq, text). State is kept by source: what is not yet cut, the pieces that came
out of order, and how many chunks and characters went out. Chunks are emitted as soon as no later text can change them;
an empty piece marked `last` flushes the rest. Checkpoints and recovery are Spark's own (checkpointLocation).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "source string, chunk_index long, offset long, content string"
STATE = "rest string, next_seq long, held string, chunks long, offset long"

#: From the text so far and whether it has ended: chunks and what is left over.
Cutter = Callable[[str, bool], tuple[list[str], str]]


def fixed(size: int) -> Cutter:
    def cut(text: str, ended: bool) -> tuple[list[str], str]:
        n = len(text) // size * size
        out = [text[i : i + size] for i in range(0, n, size)]
        return (out + [text[n:]], "") if ended and text[n:] else (out, text[n:])

    return cut


def sentences(most: int = 5, flush_at: int = 2_000_000) -> Cutter:
    """Packs of sentences; a text without a stop is flushed at `flush_at` characters."""
    stop = re.compile(r"[.!?]+\s+")

    def cut(text: str, ended: bool) -> tuple[list[str], str]:
        ends = [m.end() for m in stop.finditer(text)]
        out, start = [], 0
        for k in range(most - 1, len(ends), most):
            out.append(text[start : ends[k]])
            start = ends[k]
        if len(text) - start > flush_at or (ended and text[start:].strip()):
            return [*out, text[start:]], ""
        return out, "" if ended else text[start:]

    return cut


def paragraphs() -> Cutter:
    gap = re.compile(r"\n\s*\n")

    def cut(text: str, ended: bool) -> tuple[list[str], str]:
        *done, rest = gap.split(text)
        out = [p for p in done if p.strip()]
        return (out + [rest] if rest.strip() else out, "") if ended else (out, rest)

    return cut


def words(size: int) -> Cutter:
    unit = re.compile(r"\S+\s+")

    def cut(text: str, ended: bool) -> tuple[list[str], str]:
        ends = [m.end() for m in unit.finditer(text)]
        out, start = [], 0
        for k in range(size - 1, len(ends), size):
            out.append(" ".join(text[start : ends[k]].split()))
            start = ends[k]
        if ended and text[start:].strip():
            return [*out, " ".join(text[start:].split())], ""
        return out, "" if ended else text[start:]

    return cut


def chunk_stream(pieces: DataFrame, cutter: Cutter) -> DataFrame:
    """pieces: streaming rows source, seq (from 0), text, last. Pieces that come early wait for those before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        rest, due, held, chunks, offset = state.get if state.exists else ("", 0, "{}", 0, 0)
        waiting = {int(k): v for k, v in json.loads(held).items()}
        for f in frames:
            for seq, text, last in zip(f["seq"], f["text"], f["last"], strict=True):
                if int(seq) >= due:
                    waiting.setdefault(int(seq), [text or "", bool(last)])
        # columns, as a frame of rows costs more than a small source's chunks
        first, made_now, places, ended = chunks, [], [], False
        while due in waiting and not ended:
            text, ended = waiting.pop(due)
            due += 1
            made, rest = cutter(rest + text, ended)
            for c in made:
                made_now.append(c)
                places.append(offset)
                chunks, offset = chunks + 1, offset + len(c)
        if ended:
            state.remove()
        else:
            state.update((rest, due, json.dumps(waiting), chunks, offset))
        if made_now:
            yield pd.DataFrame({"source": key[0], "chunk_index": range(first, chunks), "offset": places, "content": made_now})

    grouped = pieces.select("source", "seq", "text", F.coalesce("last", F.lit(False)).alias("last")).groupBy("source")
    return grouped.applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone; one without is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling windows of event time; rows later than the watermark are left out."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
