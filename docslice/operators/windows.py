"""Windows of bytes and access at an offset, without reading a file into one value more often than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_windows(files: DataFrame, size: int, overlap: int = 0, content: str = "content", key: str = "path") -> DataFrame:
    """key, window, start, n_bytes, modality, text: windows begin every `size` bytes and hold `overlap` bytes before that;
    text is null and the modality mixed where a window is no valid UTF-8."""
    n = F.octet_length(content)
    each = files.filter(n > 0).select(key, F.col(content).alias("_c"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("_p"))
    start = F.greatest(F.lit(0), F.col("_p") - overlap)
    piece = F.substring("_c", start + 1, F.least(F.col("_n"), F.col("_p") + size) - start)
    made = each.select(key, F.floor(F.col("_p") / size).cast("long").alias("window"), start.cast("long").alias("start"), piece.alias("_b"))
    valid = F.is_valid_utf8(F.col("_b").cast("string"))
    return made.select(key, "window", "start", F.octet_length("_b").cast("long").alias("n_bytes"), F.when(valid, "text").otherwise("mixed").alias("modality"), F.when(valid, F.decode("_b", "UTF-8")).alias("text"))


def chunk_at(chunks: DataFrame, offset: Column | int, start: str = "start", length: str = "n_bytes") -> DataFrame:
    """Chunks that hold a byte offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return chunks.filter((F.col(start) <= at) & (at < F.col(start) + F.col(length)))


def head_tail_digest(content: Column, part: int = 65536) -> Column:
    """MD5 of the first and last `part` bytes and the size: tells a changed file without reading all of it."""
    n = F.octet_length(content)
    tail = F.when(n > part, F.substring(content, F.greatest(F.lit(1), n - part + 1), F.lit(part))).otherwise(F.lit(b""))
    return F.md5(F.concat(F.substring(content, F.lit(1), F.lit(part)), tail))
