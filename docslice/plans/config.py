"""Configured pipelines from JSON or YAML texts and the environment, and plug-in modules: loading and checking."""

from __future__ import annotations

import importlib.util
import json
import os
import traceback
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.plans import catalog

PREFIX = "DOCSLICE_"
FIELDS = {"before", "strategy", "settings", "after"}


def parsed(text: str) -> dict:
    """A configuration from JSON, or from YAML where the yaml library is installed."""
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and the yaml library is not installed") from None
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("a configuration is an object")
    return out


def checked(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing if it can run."""
    out = [f"unknown field {k}" for k in sorted(set(config) - FIELDS)]
    if (s := config.get("strategy", "sentence_based")) not in catalog.STRATEGIES:
        out.append(f"unknown strategy {s}")
    out += [f"unknown step {n} before" for n in config.get("before", []) if n not in catalog.BEFORE]
    out += [f"unknown step {s.get('step')} after" for s in config.get("after", []) if s.get("step") not in catalog.AFTER]
    return out


def with_environment(config: dict, environment: dict[str, str] | None = None) -> dict:
    """DOCSLICE_STRATEGY, and DOCSLICE_SETTINGS_<NAME> for each setting (JSON values, else texts), over a configuration."""
    env = os.environ if environment is None else environment
    out = config | {"settings": dict(config.get("settings", {}))}
    for name, value in sorted(env.items()):
        if name == f"{PREFIX}STRATEGY":
            out["strategy"] = value
        elif name.startswith(f"{PREFIX}SETTINGS_"):
            try:
                value = json.loads(value)
            except ValueError:
                pass
            out["settings"][name.removeprefix(f"{PREFIX}SETTINGS_").lower()] = value
    return out


def read(spark: SparkSession, path: str) -> dict:
    """A configuration file from any store that Spark reads."""
    return parsed("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def load(path: str, spark: SparkSession | None = None) -> dict[str, Callable[..., DataFrame]]:
    """Strategies of a module file: its STRATEGIES, a dictionary of names to functions from a DataFrame. They are
    registered under these names; with a session the file goes to the executors as well."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path} is no module")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    own = getattr(module, "STRATEGIES", {})
    for name, function in own.items():
        catalog.register(name, function, override=False)
    if spark is not None:
        spark.sparkContext.addPyFile(path)
    return own


def validate(strategy: Callable[..., DataFrame], docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[str]:
    """Problems of a strategy on some documents: its columns, numbering, empty chunks, documents without any chunk, and
    whether it gives the same twice."""
    try:
        first = strategy(docs)
        missing = {key, "chunk_index", "content"} - set(first.columns)
        if missing:
            return [f"missing columns {', '.join(sorted(missing))}"]
        own = first.select(key, "chunk_index", "content")
        told = own.agg(
            F.count("*").alias("n"), F.sum((~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False))).cast("int")).alias("empty"), F.sum(F.xxhash64(key, "chunk_index", "content").cast("decimal(38,0)")).alias("digest")
        ).first()
        out = [] if told["n"] else ["no chunks"]
        if told["empty"]:
            out.append(f"{told['empty']} empty chunks")
        by = own.groupBy(key).agg(F.count("*").alias("n"), F.min("chunk_index").alias("a"), F.max("chunk_index").alias("z"), F.count_distinct("chunk_index").alias("d"))
        if not by.filter("a <> 0 OR z <> n - 1 OR d <> n").isEmpty():
            out.append("chunks are not numbered from 0 without gaps")
        if not docs.filter(F.col(text).rlike(r"\S")).join(by, key, "left_anti").isEmpty():
            out.append("documents without chunks")
        again = strategy(docs).agg(F.sum(F.xxhash64(key, "chunk_index", "content").cast("decimal(38,0)")).alias("digest")).first()
        if again["digest"] != told["digest"]:
            out.append("another result the second time")
        return out
    except Exception as e:  # whatever a plug-in raises is its problem, told and not passed on
        return [f"raised {type(e).__name__}: {e}", traceback.format_exc(limit=-1)]
