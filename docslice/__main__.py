"""Command line: `spark-submit` or `python -m docslice` with list, chunk, directory, validate, benchmark or check."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.operators import chunkops, feedback
from docslice.plans import catalog, config
from docslice.runtime import session, ship
from docslice.sources import files


def documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """doc_id, text from a Parquet table with these columns, or from the files of a folder."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return files.text_files(spark, path, glob).select(F.col("path").alias("doc_id"), "text")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("docslice", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; none: that of spark-submit, or local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    own = sub.add_parser("list", help="strategies of the catalogue")
    own.add_argument("--category")
    for name in ("chunk", "directory"):
        own = sub.add_parser(name, help="cut documents and write the chunks")
        own.add_argument("input")
        own.add_argument("output")
        own.add_argument("--strategy")
        own.add_argument("--config", help="JSON or YAML file")
        own.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        own.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "text", "yaml"))
        own.add_argument("--glob", default="*")
    own = sub.add_parser("benchmark", help="times of some strategies")
    own.add_argument("input")
    own.add_argument("--strategies", default="fixed_size,sentence_based,paragraph_based,fastcdc,recursive")
    own.add_argument("--glob", default="*")
    own = sub.add_parser("check", help="quality of the chunks of a strategy by document")
    own.add_argument("input")
    own.add_argument("--strategy", default="sentence_based")
    own.add_argument("--glob", default="*")
    own = sub.add_parser("validate", help="problems of a configuration, or of the strategies of a module")
    own.add_argument("file")
    own.add_argument("--input")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "list":
        for name, (_, category, speed, quality) in sorted(catalog.STRATEGIES.items()):
            if a.category in (None, category):
                print(json.dumps({"strategy": name, "category": category, "speed": speed, "quality": quality}))
        return 0
    if a.command == "validate" and not a.file.endswith(".py"):
        with open(a.file, encoding="utf-8") as f:  # a file of the machine that starts the job
            problems = config.checked(config.parsed(f.read()))
        print("\n".join(problems) or "fine")
        return int(bool(problems))
    spark = spark or (SparkSession.builder.master(a.master).getOrCreate() if a.master else SparkSession.getActiveSession() or session())
    ship(spark)
    if a.command == "validate":
        docs = documents(spark, a.input, "*") if a.input else spark.createDataFrame([(1, "One. Two!\n\nThree?"), (2, "word " * 500)], "doc_id long, text string")
        bad = {name: p for name, f in config.load(a.file, spark).items() if (p := config.validate(f, docs))}
        print(json.dumps(bad, indent=1) if bad else "fine")
        return int(bool(bad))
    docs = documents(spark, a.input, a.glob)
    if a.command == "benchmark":
        print(files.report(feedback.quick_benchmark(docs, a.strategies.split(","), catalog.chunk), "seconds by strategy"))
        return 0
    if a.command == "check":
        print(files.report(chunkops.quality(catalog.chunk(docs, a.strategy), docs).agg(*(F.round(F.avg(c), 4).alias(c) for c in ("overall", "coherence", "boundary", "coverage"))), f"quality of {a.strategy}"))
        return 0
    plan = config.read(spark, a.config) if a.config else {}
    plan = config.with_environment(plan)
    if a.strategy:
        plan["strategy"] = a.strategy
    for item in a.set:
        name, _, value = item.partition("=")
        try:
            value = json.loads(value)
        except ValueError:
            pass
        plan["settings"][name] = value
    if problems := config.checked(plan):
        print("\n".join(problems), file=sys.stderr)
        return 2
    files.write_chunks(catalog.run(docs, plan), a.output, a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
