"""Office documents: blocks (paragraphs, headings, tables) of docx, odt and rtf bytes, and chunkers on blocks.

Blocks are rows (doc_id, block_index, level, kind, text); level is a heading's, 0 for others. Bytes of no known format
are read as text with a block a paragraph; null bytes give no blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.functions import text as T
from docslice.operators.kernel import chunk_rows
from docslice.runtime import arrow_rows

Block = tuple[str, int, str]  # kind, level, text
_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def table_text(rows: list[list[str]]) -> str:
    """Cells padded to the width of their column (3 at least)."""
    if not rows:
        return ""
    widths = [max(3, *(len(r[i]) if i < len(r) else 0 for r in rows)) for i in range(len(rows[0]))]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)) for r in rows)


def _inner(e: ElementTree.Element, leaf: str) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == leaf)


def docx_blocks(data: bytes) -> Iterator[Block]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    for e in next(x for x in root if _local(x) == "body"):
        if _local(e) == "tbl":
            rows = [[" ".join(filter(None, (_inner(p, "t") for p in c.iter() if _local(p) == "p"))) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            yield "table", 0, table_text(rows)
        elif _local(e) == "p" and (text := _inner(e, "t").strip()):
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = re.fullmatch(r"Heading\s*(\d)", style, re.I)
            yield ("heading", int(level[1]), text) if level else ("paragraph", 0, text)


def odt_blocks(data: bytes) -> Iterator[Block]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))

    def walk(e: ElementTree.Element) -> Iterator[Block]:
        name = _local(e)
        if name == "table":
            yield "table", 0, table_text([["".join(c.itertext()).strip() for c in r if _local(c) == "table-cell"] for r in e.iter() if _local(r) == "table-row"])
        elif name in ("p", "h"):
            if text := "".join(e.itertext()).strip():
                level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level")), 1)
                yield ("heading", level, text) if name == "h" else ("paragraph", 0, text)
        else:
            for x in e:
                yield from walk(x)

    yield from walk(next(x for x in root if _local(x) == "body"))


def rtf_text(data: str) -> str:
    """Text of RTF: control words go, paragraphs end lines, escapes are decoded, groups of tables and pictures go."""
    out: list[str] = []
    stack, skip, after = [], False, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", data):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in _SKIPPED:
            skip = True
        elif skip:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            after = 1  # the stand-in for readers without Unicode
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif code:
            out.append("" if after else bytes([int(code, 16)]).decode("cp1252", "replace"))
            after = 0
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif plain:
            out.append(plain[after:])
            after = 0
    return "".join(out)


def blocks_of(data: bytes | None) -> list[Block]:
    if not data:
        return []
    if data[:2] == b"PK":
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        if "word/document.xml" in names:
            return list(docx_blocks(data))
        return list(odt_blocks(data)) if "content.xml" in names else []
    text = rtf_text(data.decode("latin-1")) if data[:5] == b"{\\rtf" else data.decode("utf-8", "replace")
    gap = r"\n" if data[:5] == b"{\\rtf" else r"\r?\n\s*\r?\n"
    return [("paragraph", 0, p.strip()) for p in re.split(gap, text) if p.strip()]


def office_blocks(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Blocks of each row's bytes; a file that can't be read gives one block of kind `error`."""
    kind = files.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(0), b.column(1), strict=True):
                try:
                    found = blocks_of(data.as_py())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
                    found = [("error", 0, type(e).__name__)]
                if found:
                    kinds, levels, texts = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, b.schema.types[0]), pa.array(range(n), pa.int64()), pa.array(kinds, pa.string()), pa.array(levels, pa.int32()), pa.array(texts, pa.string())], [key, "block_index", "kind", "level", "text"])

    return arrow_rows(files.select(key, content), rows, f"{key} {kind}, block_index long, kind string, level int, text string")


def _gathered(blocks: DataFrame, group, shortest: int, key: str) -> DataFrame:
    """Blocks of equal (key, group) as a chunk in order; chunks shorter than `shortest` go, and the others keep their
    order. A document's blocks fit where the document did."""
    by = blocks.groupBy(key, group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")
    out = by.select(key, "g", text.alias("content")).filter(F.length(T.strip(F.col("content"))) >= shortest)
    index = F.row_number().over(Window.partitionBy(key).orderBy("g")) - 1
    return out.select(key, index.cast("long").alias("chunk_index"), "content", F.length("content").cast("long").alias("size"))


def by_paragraphs(blocks: DataFrame, most: int = 5, shortest: int = 50, key: str = "doc_id") -> DataFrame:
    """So many paragraphs a chunk (also the rule for pages, whose breaks the formats do not keep)."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("block_index")) - 1
    return _gathered(blocks.filter("kind <> 'table'").withColumn("at", at), F.floor(F.col("at") / most), shortest, key)


def by_headings(blocks: DataFrame, levels: tuple[int, ...] = (1, 2, 3), shortest: int = 50, key: str = "doc_id") -> DataFrame:
    """A chunk from each heading of the given levels to the next one."""
    order = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum(F.col("level").isin(*levels).cast("int")).over(order)
    return _gathered(blocks.filter("kind <> 'table'").withColumn("section", section), F.col("section"), shortest, key)


def _packed(texts: list[str], most: int, shortest: int) -> Iterator[str]:
    held, n = [], 0
    for t in [*texts, None]:
        if held and (t is None or n + len(t) > most):
            if len((content := "\n\n".join(held)).strip()) >= shortest:
                yield content
            held, n = [], 0
        if t is not None:
            held.append(t)
            n += len(t)


def by_size(blocks: DataFrame, most: int = 2000, shortest: int = 50, key: str = "doc_id") -> DataFrame:
    """Paragraphs packed up to `most` characters."""
    by = blocks.filter("kind <> 'table'").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]).alias("texts"))
    return chunk_rows(by, lambda texts: _packed(texts, most, shortest), ["texts"], key=key)
