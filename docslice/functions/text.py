"""Column expressions on text: splitters, pre-processing, surface counts. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\S+"
CUT = "\x01"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def kept(parts: Column) -> Column:
    """Stripped parts that are not empty."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    """Split after runs of . ! ? that white space or the end follows."""
    return kept(F.split(F.regexp_replace(c, r"([.!?]+)(\s+|\z)", f"$1{CUT}"), CUT))


def sentences_after_stop(c: Column) -> Column:
    """Split at white space that a stop precedes."""
    return kept(F.split(c, r"(?<=[.!?])\s+"))


def sentences_or_fallback(c: Column) -> Column:
    """Sentences; a long text that gives one or none is cut by short lines, blank lines or length."""
    found, lines = sentences(c), F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.size(words(x)) <= 2))
    blocks = kept(F.split(c, "\n\n"))
    slices = kept(F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(500)), lambda s: c.substr(s + 1, F.lit(500))))
    fallback = F.when((F.size(lines) > 5) & (short > 0.7 * F.size(lines)), lines).when(c.contains("\n\n"), blocks).when(F.length(c) > 2000, slices).otherwise(found)
    return F.when((F.size(found) == 0) | ((F.size(found) == 1) & (F.length(c) > 1000)), fallback).otherwise(found)


def paragraphs(c: Column) -> Column:
    """Split at blank lines; white space inside becomes one space."""
    return F.transform(kept(F.split(strip(c), r"\r?\n\s*\r?\n")), lambda x: F.regexp_replace(x, r"\s+", " "))


def normal_spaces(c: Column) -> Column:
    """Runs of spaces and tabs to one, three or more line ends to two, no space at line ends or at both ends."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+(\n|\z)", "$1"))


FRAME_WORDS = ("page", "chapter", "copyright", "confidential", "draft", "footer", "header")


def without_frames(c: Column) -> Column:
    """Without lines of under 20 characters among the first and last five that name a header or footer."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    named = lambda x: F.lower(x).rlike("|".join(FRAME_WORDS))
    return F.array_join(F.filter(lines, lambda x, i: ~(((i < 5) | (i >= n - 5)) & (F.length(strip(x)) < 20) & named(x))), "\n")


def without_markup(c: Column) -> Column:
    """Without tags, and without Markdown's links, emphasis, headings and code marks."""
    for pattern, to in ((r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"[*_~`]+", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def plain_quotes(c: Column) -> Column:
    """Curly quotes, dashes and wide spaces to their ASCII forms."""
    c = F.regexp_replace(c, "[‘’‚‛]", "'")
    c = F.regexp_replace(c, "[“”„‟]", '"')
    c = F.regexp_replace(c, "[‐-―]", "-")
    return F.regexp_replace(c, "[   -   　]", " ")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def sentences_by(c: Column, separators: str = ".!?。！？") -> Column:
    """Split after each run of separators, with the white space and one quote that follow it."""
    marks = "".join(f"\\{x}" for x in separators)
    return kept(F.split(F.regexp_replace(c, rf"""([{marks}]+\s*["']?\s*)""", f"$1{CUT}"), CUT))


def bare_words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def truncated(c: Column, most: int) -> Column:
    """The first `most` characters, to the last space among them if it lies in their last fifth."""
    head = F.substring(c, 1, most)
    last = most - F.locate(" ", F.reverse(head))
    cut = (F.locate(" ", F.reverse(head)) > 0) & (last > 0.8 * most)
    return F.when(F.length(c) <= most, c).when(cut, head.substr(F.lit(1), last)).otherwise(head)


def without_comments(c: Column, family: str) -> Column:
    """Without comments of the `hash` family (on lines without quotes) or the `slash` family (strings are not told apart)."""
    if family == "hash":
        return F.regexp_replace(c, r"""(?m)^([^"'#\n]*)#[^"'\n]*$""", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


#: What tells a line that begins a function or a class, whatever the language.
FUNCTION_WORDS = ("def ", "function ", "func ", "fn ", "sub ", "procedure ")
CLASS_WORDS = ("class ", "interface ", "struct ", "type ", "enum ")


def code_outline(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line (from 1), kind, content of the lines that name a function or a class."""
    each = df.select(key, F.posexplode(F.split(filled(F.col(text)), "\n")).alias("p", "l")).select(key, (F.col("p") + 1).cast("long").alias("line"), strip(F.col("l")).alias("content"))
    has = lambda words: reduce(lambda a, b: a | b, (F.col("content").contains(w) for w in words))
    return each.select(key, "line", F.when(has(FUNCTION_WORDS), "function").when(has(CLASS_WORDS), "class").alias("kind"), "content").filter(F.col("kind").isNotNull())


def _nfkc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in b.column(1).to_pylist()], pa.string())], b.schema.names)


def normalised(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and text in NFKC (Spark has no function for it), its spaces, dashes and quotes plain."""
    from docslice.runtime import arrow_rows

    made = arrow_rows(df.select(F.col(key), F.col(text)), _nfkc, f"{key} {df.schema[key].dataType.simpleString()}, {text} string")
    c = F.regexp_replace(F.col(text), "[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000]", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[\u2010-\u2015]", "-"), "[\u2018\u2019]", "'")
    return made.select(key, F.regexp_replace(c, "[\u201c\u201d]", '"').alias(text))
