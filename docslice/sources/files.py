"""Sources and sinks: whole text files, bytes, CSV, JSON lines; chunk dumps and reports. All paths go through Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.functions.analyze import encoding, modality, select_strategy


def text_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, text: a row for each file that is not empty, decoded by its mark or as UTF-8, else Latin-1."""
    files = binary_files(spark, path, glob, recursive)
    code = encoding(F.col("content"))
    text = F.when(code == "utf-8-sig", F.decode(F.substring("content", 4, 2**31 - 1), "UTF-8")).when(code == "utf-16", F.decode("content", "UTF-16")).when(code == "latin-1", F.decode("content", "ISO-8859-1")).otherwise(F.decode("content", "UTF-8"))
    return files.select("path", text.alias("text"), code.alias("encoding"))


def binary_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def catalogued(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, extension, strategy, modality of the files of a folder."""
    return select_strategy(binary_files(spark, path, glob).withColumn("modality", modality(F.col("content")))).drop("content", "modificationTime")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Cells stay strings, the first row is the header, rows may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: a variant for each line that is JSON."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("value")).filter(F.col("value").isNotNull())


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of pieces from JSON lines {source, seq, text, last} that arrive in a folder."""
    return spark.readStream.schema("source string, seq long, text string, last boolean").json(path)


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet") -> None:
    """parquet, json, csv, text (contents) or yaml (a list entry for each chunk)."""
    if form == "yaml":
        quoted = F.to_json(F.struct(*chunks.columns))  # JSON is YAML
        chunks.select(F.concat(F.lit("- "), quoted).alias("value")).write.text(path)
    elif form == "text":
        chunks.select(F.concat("content", F.lit("\n")).alias("value")).write.text(path)
    else:
        chunks.write.format(form).save(path)


def report(summary: DataFrame, title: str, most: int = 1000) -> str:
    """A readable report of a small summary (at most `most` rows)."""
    rows = [r.asDict(recursive=True) for r in summary.limit(most).collect()]
    return "\n".join([title, "=" * len(title), *(json.dumps(r, default=str, sort_keys=True) for r in rows)])
