"""Scenes of sampled frames: differences of histograms or of structure, boundaries, and segments of bounded length.

Frames are rows (media_id, t in seconds, and features from any decoder): `hist` an array of bins, or `grey` the grey
levels of a small frame, row by row. Differences come from windows; boundaries are a fold over a medium's changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.operators.kernel import chunk_rows
from docslice.operators.semantic import dot
from docslice.runtime import arrow_rows


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays; 1 where one of them is even."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    cross = dot(a, b) - total(a) * total(b) / n
    spread = (dot(a, a) - total(a) * total(a) / n) * (dot(b, b) - total(b) * total(b) / n)
    return F.when(spread > 1e-12, cross / F.sqrt(spread)).otherwise(1.0)


def _before(key: str):
    return Window.partitionBy(key).orderBy("t")


def histogram_changes(frames: DataFrame, key: str = "media_id") -> DataFrame:
    """key, t, difference: (1 - correlation) * 100 of each frame's histogram and the one before."""
    pair = frames.select(key, "t", "hist", F.lag("hist").over(_before(key)).alias("past")).filter(F.col("past").isNotNull())
    return pair.select(key, "t", F.round((1 - correlation(F.col("hist"), F.col("past"))) * 100, 6).alias("difference"))


def _kernel(width: int = 11, sigma: float = 1.5) -> np.ndarray:
    k = np.exp(-((np.arange(width) - width // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _blur_matrix(n: int) -> np.ndarray:
    """The blur of a side of n as a matrix, its padding at the edges included."""
    k, r = _kernel(), 5
    at = np.pad(np.arange(n), r, mode="reflect" if n > r else "symmetric")
    out = np.zeros((n, n))
    for i in range(n):
        np.add.at(out[i], at[i : i + 2 * r + 1], k)
    return out


def ssims(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of pairs of grey images, all of one shape (Gaussian window of 11, deviation 1.5)."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    a, b = a.astype(float), b.astype(float)
    down, across = _blur_matrix(a.shape[1]), _blur_matrix(a.shape[2]).T
    blurred = lambda x: down @ x @ across
    ma, mb = blurred(a), blurred(b)
    va, vb, cov = blurred(a * a) - ma * ma, blurred(b * b) - mb * mb, blurred(a * b) - ma * mb
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean((1, 2))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    return float(ssims(a[None], b[None])[0])


def _paired(now: pa.Array, past: pa.Array, width: int) -> np.ndarray:
    """1 - SSIM of each pair of lists; pairs of one size are taken together, a bounded number at a time."""
    sizes = np.asarray(now.value_lengths())
    out = np.zeros(len(now))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), step := max(1, (1 << 18) // max(1, int(n)))):
            own = pa.array(at[k : k + step])
            x, y = (np.asarray(c.take(own).flatten()).reshape(len(own), -1, width) for c in (now, past))
            out[at[k : k + step]] = 1 - ssims(x, y)
    return out


def structure_changes(frames: DataFrame, width: int, key: str = "media_id") -> DataFrame:
    """key, t, difference: (1 - SSIM) * 100 of each frame's grey levels (rows of `width`) and those before."""
    pair = frames.select(key, "t", "grey", F.lag("grey").over(_before(key)).alias("past")).filter(F.col("past").isNotNull())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [round(v, 6) for v in (_paired(b.column(2), b.column(3), width) * 100).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.float64())], [key, "t", "difference"])

    return arrow_rows(pair, rows, f"{key} {frames.schema[key].dataType.simpleString()}, t double, difference double")


def _segments(times: list[float], duration: float, shortest: float, longest: float) -> Iterator[tuple]:
    cuts: list[float] = []
    for t in times:
        if not cuts or t - cuts[-1] >= shortest:
            cuts.append(t)
    start = 0.0
    for t in cuts:
        if t <= 0:
            continue
        n = max(1, math.ceil((t - start) / longest))
        for k in range(n):
            yield "", round(start + k * (t - start) / n, 6), round(start + (k + 1) * (t - start) / n, 6)
        start = t
    if start < duration:
        yield "", start, duration


def scene_segments(changes: DataFrame, media: DataFrame, threshold: float = 30.0, shortest: float = 2.0, longest: float = 120.0, key: str = "media_id") -> DataFrame:
    """key, segment, start, stop: scenes between changes over the threshold that lie `shortest` apart; those over
    `longest` are split evenly, but for the last one. media: key and duration (seconds)."""
    times = changes.filter(F.col("difference") > threshold).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("times"))
    full = media.select(key, F.col("duration").cast("double").alias("duration")).join(times, key, "left").withColumn("times", F.coalesce("times", F.array().cast("array<double>")))
    made = chunk_rows(full, partial(_segments, shortest=shortest, longest=longest), ["times", "duration"], "start double, stop double", key)
    return made.select(key, F.col("chunk_index").alias("segment"), "start", "stop")


def edge_patches(df: DataFrame, patch: int, stride: int, key: str = "image_id") -> DataFrame:
    """key, x, y: corners, patches along the edges at twice the stride, and the centre; each place once."""
    w, h = F.greatest(F.lit(0), F.col("width") - patch).cast("int"), F.greatest(F.lit(0), F.col("height") - patch).cast("int")
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero, none = F.lit(0), F.array().cast("array<struct<x:int,y:int>>")
    along = lambda side: F.when(F.col(side) >= patch, F.sequence(F.lit(0), (F.col(side) - patch).cast("int"), F.lit(2 * stride))).otherwise(F.array().cast("array<int>"))
    top = F.flatten(F.transform(along("width"), lambda x: F.array(at(x, zero), at(x, h))))
    side = F.flatten(F.transform(along("height"), lambda y: F.array(at(zero, y), at(w, y))))
    cx, cy = F.floor(F.col("width") / 2) - patch // 2, F.floor(F.col("height") / 2) - patch // 2
    centre = F.when((cx >= 0) & (cy >= 0), F.array(at(cx, cy))).otherwise(none)
    places = F.array_distinct(F.concat(F.array(at(zero, zero), at(w, zero), at(zero, h), at(w, h)), top, side, centre))
    return df.select(key, F.explode(places).alias("p")).select(key, F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))
