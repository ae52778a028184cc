"""Feedback, throughput and the choice among strategies by what was measured."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_feedback(signals: DataFrame, last: int = 5, least: int = 3, below: float = 0.5, key: str = "strategy", order: str = "at") -> DataFrame:
    """key, order, mean_score (weighted, of the last signals), main_kind (the commonest kind among them; of several the
    first by name) and adapt (whether enough signals lie low enough). signals: key, order, score, weight, kind."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - last, 0)
    total = F.sum("weight").over(w)
    mean = F.round(F.when(total > 0, F.sum(F.col("score") * F.col("weight")).over(w) / total), 9)
    kinds = F.collect_list("kind").over(w)
    own = signals.select(key, order, mean.alias("mean_score"), kinds.alias("kinds"), F.count("*").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    ranked = F.array_sort(F.transform(F.array_distinct("kinds"), lambda k: F.struct((-F.size(F.filter("kinds", lambda x: x == k))).alias("n"), k.alias("k"))))
    return own.select(key, order, "mean_score", ranked[0]["k"].alias("main_kind"), ((F.col("seen") >= least) & (F.col("mean_score") < below)).alias("adapt"))


def throughput(runs: DataFrame, *by: str) -> DataFrame:
    """files, chunks and megabytes a second. runs: chunks, n_bytes, seconds, a row for each file."""
    made = runs.groupBy(*by).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("n_bytes").alias("n_bytes"), F.sum("seconds").alias("seconds"))
    rate = lambda x: F.round(F.when(F.col("seconds") > 0, x / F.col("seconds")).otherwise(0.0), 6)
    return made.select(*by, "files", "chunks", rate(F.col("files")).alias("files_per_second"), rate(F.col("chunks")).alias("chunks_per_second"), rate(F.col("n_bytes") / 1048576).alias("mb_per_second"))


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """share, mb_per_second and eta_seconds of a run that has read `done` of `total` bytes."""
    rate = F.when(seconds > 0, done / 1048576 / seconds).otherwise(0.0)
    return {"share": F.round(F.when(total > 0, done / total).otherwise(0.0), 6), "mb_per_second": F.round(rate, 6), "eta_seconds": F.round(F.when((rate > 0) & (total > 0), (total - done) / 1048576 / rate), 6)}


def best(metrics: DataFrame, *by: str) -> DataFrame:
    """The fastest strategy, and those of the highest throughput, least memory and highest quality. metrics: strategy,
    seconds, mb_per_second, memory_mb, quality; of equals the first by name."""
    first = lambda value: F.min_by("strategy", F.struct(value, "strategy"))
    ok = metrics.filter(F.col("seconds") > 0)
    return ok.groupBy(*by).agg(first(F.col("seconds")).alias("fastest"), first(-F.col("mb_per_second")).alias("highest_throughput"), first(F.col("memory_mb")).alias("lowest_memory"), F.min_by("strategy", F.struct(-F.coalesce("quality", F.lit(-1e300)), "strategy")).alias("highest_quality"))


def quick_benchmark(docs: DataFrame, names: list[str], chunk: Callable[[DataFrame, str], DataFrame], most: int = 5) -> DataFrame:
    """strategy, seconds, chunks of the first `most` strategies, the fastest first: each is run to its last row."""
    rows = []
    for name in names[:most]:
        began = time.perf_counter()
        rows.append((name, chunk(docs, name).select(F.count("content").alias("n")).first()["n"], time.perf_counter() - began))
    return docs.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[2]), "strategy string, chunks long, seconds double")


def first_success(chunks: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Of chunks of several strategies (column strategy) those of each document's first strategy that gave any, with the
    counts of all (a JSON object)."""
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("strategy"))
    counts = chunks.groupBy(key, "strategy").agg(F.count("*").alias("n"))
    told = counts.groupBy(key).agg(F.min_by("strategy", place).alias("primary"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "strategy", "n"))), ",").alias("counts"))
    return chunks.join(told, key).filter(F.col("strategy") == F.col("primary")).drop("primary")
