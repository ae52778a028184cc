"""Adaptation rules: a strategy's parameters after a score of some kind. Pure functions on parameter dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scaled(p: dict, name: str, by: float, least: int | None = None, most: int | None = None) -> dict:
    v = int(p[name] * by)
    if least is not None:
        v = max(least, v)
    if most is not None:
        v = min(most, v)
    return p | {name: v}


def fixed_size(p: dict, score: float, kind: str) -> dict:
    if score >= 0.5:
        return p
    if kind == "quality":
        return _scaled(p, "size", 1.2, most=4096)
    return _scaled(p, "size", 0.8, least=min(50, int(p["size"] * 0.2))) if kind == "performance" else p


def sentence_based(p: dict, score: float, kind: str) -> dict:
    if score >= 0.5:
        return p
    if kind == "quality":
        return p | {"max_sentences": max(p["min_sentences"], p["max_sentences"] - 1)}
    if kind == "coverage":
        return p | {"max_sentences": min(20, p["max_sentences"] + 1)}
    return _scaled(p, "max_chars", 0.8, least=500) if kind == "performance" else p


def paragraph_based(p: dict, score: float, kind: str) -> dict:
    if score >= 0.5:
        return p
    if kind == "quality":
        return p | {"max_paragraphs": max(1, p["max_paragraphs"] - 1)}
    if kind == "coverage":
        return p | {"max_paragraphs": min(10, p["max_paragraphs"] + 1)}
    return p | {"merge_below": 0} if kind == "speed" else p


def word_windows(p: dict, score: float, kind: str) -> dict:
    if score < 0.5 and kind == "quality":
        p = _scaled(p, "words_per_chunk", 0.8, least=5)
    elif score < 0.5 and kind == "performance":
        p = _scaled(p, "words_per_chunk", 1.2, most=5000)
    elif score > 0.8 and kind == "quality":
        p = _scaled(p, "words_per_chunk", 1.1, most=1000)
    return p | {"overlap": min(p.get("overlap", 0), p["words_per_chunk"] - 1)}


def token_windows(p: dict, score: float, kind: str) -> dict:
    rules = {("low", "quality"): (0.8, 100, None, 1.2), ("low", "performance"): (1.2, None, 4000, 0.8), ("high", "quality"): (1.1, None, 2000, 1.0), ("high", "performance"): (1.05, None, 3000, 1.0)}
    rule = rules.get(("low" if score < 0.5 else "high" if score > 0.8 else "", kind))
    if not rule:
        return p
    by, least, most, overlap = rule
    p = _scaled(p, "tokens_per_chunk", by, least, most)
    return p | {"overlap": min(int(p["overlap"] * overlap), p["tokens_per_chunk"] - 1)}


def fastcdc(p: dict, score: float, kind: str) -> dict:
    if score >= 0.5:
        return p
    if kind == "dedup":
        return _scaled(p, "avg", 1.5, most=32768)
    if kind == "performance":
        return _scaled(p, "avg", 0.8, least=2048)
    return p | {"bits": max(10, min(15, p["bits"] - 1))} if kind == "quality" else p


def overlapping_window(p: dict, score: float, kind: str, least_step: int = 1) -> dict:
    if kind == "quality" and score < 0.6:
        return _scaled(p, "step", 0.8, least=least_step)
    if kind == "quality" and score > 0.8:
        return _scaled(p, "step", 1.2, most=p["window"] - 1)
    return _scaled(p, "window", 0.8, least=p["step"] + 1) if kind == "performance" and score < 0.5 else p


def semantic(p: dict, score: float, kind: str) -> dict:
    if kind == "quality" and score < 0.5:
        return p | {"threshold": min(0.9, p["threshold"] + 0.1), "least": max(1, p["least"] - 1)}
    if kind == "quality" and score > 0.8:
        return p | {"threshold": p["threshold"] - 0.05}
    if kind == "performance" and score < 0.5:
        return p | {"most": min(20, p["most"] + 3), "threshold": p["threshold"] - 0.1}
    return p | {"threshold": min(0.9, p["threshold"] + 0.15)} if kind == "coherence" and score < 0.6 else p


def csv_rows(p: dict, score: float, kind: str) -> dict:
    if score >= 0.5:
        return p
    return _scaled(p, "block", 0.7, least=100) if kind == "quality" else _scaled(p, "block", 1.3, most=10000) if kind == "performance" else p


RULES = {"fixed_size": fixed_size, "sentence_based": sentence_based, "paragraph_based": paragraph_based, "word_windows": word_windows, "token_windows": token_windows, "fastcdc": fastcdc, "overlapping_window": overlapping_window, "semantic": semantic, "csv_rows": csv_rows}


def score_of(metrics: DataFrame) -> DataFrame:
    """Score of a run (seconds, megabytes, quality, boundary): .3 speed + .4 quality + .3 boundary."""
    speed = F.least(F.lit(1.0), F.col("megabytes") / F.greatest(F.col("seconds"), F.lit(1e-6)) / 10)
    return metrics.withColumn("score", F.round(0.3 * speed + 0.4 * F.col("quality") + 0.3 * F.col("boundary"), 6))
