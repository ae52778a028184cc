"""CSV and JSON documents: blocks, groups and sections of rows or objects.

CSV rows come as (doc, place, cells); JSON values stay variants, so their names are sorted and their text is canonical.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.operators.closed import block_rows, exploded, starts
from docslice.operators.kernel import chunk_rows

HEADER_WORDS = ("id", "name", "date", "time", "type", "status", "total", "count")


def csv_line(cells: Column) -> Column:
    """Cells with commas between, quoted where a cell needs it."""
    quoted = F.transform(cells, lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit(""))))
    return F.array_join(quoted, ",")


def rows_of(text: str | None) -> Iterator[tuple]:
    """Cells of the rows of a CSV text that are not blank; the dialect is guessed from the first 4 KB."""
    text = text or ""
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    for row in csv.reader(io.StringIO(text, newline=""), dialect):
        if any(c.strip() for c in row):
            yield "", row


def parse_csv(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, place, cells; place 0 is the header."""
    return chunk_rows(df, rows_of, [text], "cells array<string>", key).select(key, F.col("chunk_index").alias("place"), "cells")


def _rendered(rows: DataFrame, header: Column, by: list[str]) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", csv_line(F.col("cells")).alias("line")))), lambda x: x["line"])
    return rows.groupBy(*by).agg(F.concat(F.concat_ws("\r\n", header, F.array_join(lines, "\r\n")), F.lit("\r\n")).alias("content"), F.count("*").alias("n_rows"), F.min("place").alias("first"))


def csv_rows(rows: DataFrame, header: list[str], block: int = 100, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    line = csv_line(F.array(*(F.lit(h) for h in header)))
    out = _rendered(block_rows(rows, block, "place", overlap), line, [key, "block"])
    return out.select(key, F.col("block").alias("chunk_index"), "content", "n_rows")


def csv_groups(rows: DataFrame, header: list[str], column: str, key: str = "doc_id") -> DataFrame:
    """A chunk for each value of a column, in the order of first rows."""
    if column not in header:
        return csv_rows(rows, header, key=key).withColumn("value", F.lit(None).cast("string"))
    line = csv_line(F.array(*(F.lit(h) for h in header)))
    out = _rendered(rows.withColumn("value", F.col("cells")[header.index(column)]), line, [key, "value"])
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long").alias("chunk_index"), "value", "content", "n_rows")


def by_bytes(units: list[str] | None, limit: int, sep: str, head: str) -> Iterator[str]:
    """Units in order while their bytes stay in the limit; an oversize unit stands alone."""
    now: list[str] = []
    size = 0
    for u in units or []:
        n = len(u.encode())
        if now and size + n > limit:
            yield head + sep.join(now)
            now, size = [], 0
        now.append(u)
        size += n
    if now:
        yield head + sep.join(now)


def csv_memory(rows: DataFrame, header: list[str], limit: int, key: str = "doc_id") -> DataFrame:
    lines = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", csv_line(F.col("cells")).alias("line")))), lambda x: x["line"]).alias("units"))
    return chunk_rows(lines, partial(by_bytes, limit=limit, sep="\r\n", head=",".join(header) + "\r\n"), ["units"], key=key)


def header_like(cells: Column, header: list[str]) -> Column:
    """All cells upper-case, or one equals a header, or one holds a header's usual word."""
    full = F.filter(cells, lambda x: x.rlike(r"\S"))
    low = F.transform(full, F.lower)
    upper = F.forall(full, lambda x: (F.upper(x) == x) & (F.lower(x) != x))
    return upper | F.arrays_overlap(low, F.array(*(F.lit(h.lower()) for h in header))) | F.exists(low, lambda x: x.rlike("|".join(HEADER_WORDS)))


def csv_sections(rows: DataFrame, header: list[str], key: str = "doc_id") -> DataFrame:
    """A section begins at each row that looks like a header."""
    section = F.sum(header_like(F.col("cells"), header).cast("int")).over(Window.partitionBy(key).orderBy("place"))
    out = rows.withColumn("section", section.cast("long")).groupBy(key, "section").agg(F.count("*").alias("n_rows"), F.min("place").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", csv_line(F.col("cells")).alias("line")))), lambda x: x["line"]), "\r\n").alias("content"))
    return out.select(key, "section", "first", "n_rows", "content")


# JSON --------------------------------------------------------------------------------------------------------------


def json_objects(df: DataFrame, block: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of an array's objects; any other value is one chunk."""
    staged = df.select(key, F.try_parse_json(text).alias("v")).withColumn("a", F.try_variant_get("v", "$", "array<variant>"))
    parts = F.transform(starts(F.size("a"), block), lambda s: F.to_json(F.slice("a", s + 1, F.lit(block))))
    return exploded(staged, F.when(F.col("a").isNotNull(), parts).when(F.col("v").isNotNull(), F.array(F.to_json("v"))).otherwise(F.array().cast("array<string>")), key)


def json_key_groups(df: DataFrame, name: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Objects of an array by the value of a name: null as `null`, without the name as `ungrouped`, last."""
    items = df.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")).alias("place", "v"))
    own = F.try_variant_get("v", f"$.{name}", "variant")
    value = F.when(own.isNull(), "ungrouped").when(F.is_variant_null(own), "null").otherwise(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.to_json(own)))
    out = items.select(key, "place", value.alias("value"), F.to_json("v").alias("json")).groupBy(key, "value").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("content"))
    w = Window.partitionBy(key).orderBy((F.col("value") == "ungrouped").cast("int"), "first")
    return out.select(key, (F.row_number().over(w) - 1).cast("long").alias("chunk_index"), "value", "n", "content")


def _dumps(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _loads(text: str | None) -> object:
    """A document, or a list of the lines of JSON lines; none if it is neither."""
    try:
        return json.loads(text or "")
    except ValueError:
        try:
            return [json.loads(x) for x in (text or "").splitlines() if x.strip()] or None
        except ValueError:
            return None


def _nested(path: list[str], v: object) -> object:
    for name in reversed(path):
        v = {name: v}
    return v


def array_blocks(text: str | None, block: int, rebuild: bool = False) -> Iterator[tuple]:
    """Blocks of each array that is reached through objects, with its path; on demand inside the objects of the path."""

    def walk(v: object, path: list[str]) -> Iterator[tuple]:
        if isinstance(v, list):
            for i in range(0, len(v), block):
                part = v[i : i + block]
                yield _dumps(_nested(path, part) if rebuild else part), ".".join(path), i
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, [*path, k])

    return walk(_loads(text), [])


def json_arrays(df: DataFrame, block: int = 100, rebuild: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(array_blocks, block=block, rebuild=rebuild), [text], "path string, first long", key)


def shallow(v: object, depth: int, at: int = 0) -> object:
    """A value whose parts below a depth are marks."""
    if isinstance(v, dict):
        return f"<truncated_dict_depth_{at}>" if at >= depth else {k: shallow(x, depth, at + 1) for k, x in v.items()}
    if isinstance(v, list):
        return f"<truncated_list_depth_{at}>" if at >= depth else [shallow(x, depth, at + 1) for x in v]
    return v


def _shallow(text: str | None, depth: int) -> Iterator[str]:
    v = _loads(text)
    if v is not None:
        yield _dumps(shallow(v, depth))


def json_depth(df: DataFrame, depth: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(_shallow, depth=depth), [text], key=key)


def _sized(text: str | None, limit: int) -> Iterator[str]:
    v = _loads(text)
    if v is None:
        return
    for x in by_bytes([_dumps(o) for o in v] if isinstance(v, list) else [_dumps(v)], limit, ",", ""):
        yield f"[{x}]" if isinstance(v, list) else x


def json_size(df: DataFrame, limit: int = 1 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(_sized, limit=limit), [text], key=key)
