"""Statistics of content-defined chunks: content, fingerprints, estimates and quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docslice.runtime import arrow_rows


def _content(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits, text = [], []
        for c in b.column(keys):
            s = c.as_py() or ""
            n = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), np.uint8), minlength=256)
            p = n[n > 0] / max(1, n.sum())
            bits.append(float(-(p * np.log2(p)).sum()) + 0.0)
            text.append(bool(s) and sum(map(str.isprintable, s)) + sum(map(str.isspace, s)) - s.count(" ") > 0.8 * len(s))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits), pa.array(text)], [*b.schema.names, "entropy", "is_text"])


def chunk_profiles(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, n_bytes, entropy (bits a byte), compressibility (1 less its share of 8), is_text (over .8 of the
    characters are printable or space), md5, sha256, fingerprint."""
    own = chunks.select(key, "chunk_index", F.col("content").alias("content"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    made = arrow_rows(own, lambda batches: _content(batches, 2), f"{kind}, entropy double, is_text boolean")
    md5 = F.md5(F.encode("content", "UTF-8"))
    squeeze = F.when(F.col("entropy") > 0, 1 - F.col("entropy") / 8).otherwise(1.0)
    return made.select(key, "chunk_index", F.octet_length("content").cast("long").alias("n_bytes"), F.round("entropy", 6).alias("entropy"), F.round(squeeze, 6).alias("compressibility"), "is_text", md5.alias("md5"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), F.substring(md5, 1, 16).alias("fingerprint"))


def level_fingerprint(content: Column, hashes: list[Column]) -> Column:
    """16 hex digits of the SHA-256 of a content and the xor of its levels' hashes (8 bytes, big end first)."""
    mixed = F.lit(0).cast("long")
    for h in hashes:
        mixed = mixed.bitwiseXOR(h.cast("long"))
    return F.substring(F.sha2(F.concat(F.encode(content, "UTF-8"), F.unhex(F.lpad(F.hex(mixed), 16, "0"))), 256), 1, 16)


def estimate(size: Column, expected: float, share: float, least: int) -> dict[str, Column]:
    """fewest and most chunks to expect of `size` bytes: about size / expected, give or take a share (1 at least)."""
    about = F.greatest(F.lit(1), F.floor(size / expected)).cast("long")
    around = F.greatest(F.lit(1), F.floor(about * share)).cast("long")
    small = size <= least
    return {"fewest": F.when(small, 1).otherwise(F.greatest(F.lit(1), about - around)).cast("long"), "most": F.when(small, 1).otherwise(about + around).cast("long")}


def expected_size(rule: str, least: int = 2048, mask: int = 0x1FFF, primary: int = 1024, secondary: int = 4096, target: int = 8192) -> tuple[float, float]:
    """Chunk size to expect of a rule, and the share to give or take."""
    if rule == "tttd":
        hit = 1 / primary + 1 / secondary - 1 / (primary * secondary)
        return max(float(least), 1 / hit), 0.4
    if rule == "ml_cdc":
        return float(target), 0.35
    return max(float(least), float(mask + 1)), 0.25


def cut_quality(chunks: DataFrame, target: int, most: int, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), base: float = 0.9, key: str = "doc_id", size: str = "n_bytes") -> DataFrame:
    """key, chunks, size_score, cut_ratio, quality: mean size against the target, share of chunks that the content cut
    (shorter than `most`), and a fixed base for the rule's speed."""
    by = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.avg(size).alias("mean"), F.avg((F.col(size) < most).cast("double")).alias("cut"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(1 - F.col("mean") / target))
    return by.select(key, "chunks", F.round(near, 6).alias("size_score"), F.round("cut", 6).alias("cut_ratio"), F.round(weights[0] * near + weights[1] * F.col("cut") + weights[2] * base, 6).alias("quality"))


def level_quality(chunks: DataFrame, target: int, most: int, key: str = "doc_id", size: str = "n_bytes", digest: str = "digest") -> DataFrame:
    """As cut_quality for chunks of one level: .3 size, .25 cuts, .2 one level, .25 distinct digests."""
    by = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.avg(size).alias("mean"), F.avg((F.col(size) < most).cast("double")).alias("cut"), F.count_distinct(digest).alias("kinds"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(1 - F.col("mean") / target))
    return by.select(key, "chunks", F.round(0.3 * near + 0.25 * F.col("cut") + 0.2 + 0.25 * F.col("kinds") / F.col("chunks"), 6).alias("quality"))


def new_divisors(mean: Column, target: int, primary: Column, secondary: Column, samples: Column, least: int = 20) -> dict[str, Column]:
    """Divisors of the two-threshold rule after `samples` chunks of a mean size: a tenth less where chunks are over a
    fifth too large, a tenth more where they are over a fifth too small, within fixed bounds."""
    off = (samples >= least) & (F.abs(mean - target) > 0.2 * target)
    less = lambda v, bound: F.greatest(F.lit(bound), F.floor(v * 0.9)).cast("long")
    more = lambda v, bound: F.least(F.lit(bound), F.floor(v * 1.1)).cast("long")
    turn = lambda v, low, high: F.when(off & (mean > target), less(v, low)).when(off, more(v, high)).otherwise(v.cast("long"))
    return {"primary": turn(primary, 512, 4096), "secondary": turn(secondary, 1024, 16384)}
