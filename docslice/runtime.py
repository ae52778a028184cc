"""Session helpers shared by every operator: shared folder, materialised steps, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch for Python workers. Spark's own limit is 16 times that, held by both sides of each task.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (the path may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a new one;
    a cluster has no folder of its own that could serve, so that is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docslice.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docslice-")
        spark.conf.set("docslice.shared.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, in a folder of this application."""
    return f"{shared_dir(spark)}/docslice/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that were not written elsewhere are gone then."""
    drop_path(spark, f"{shared_dir(spark)}/docslice/{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: it outlives lost executors, is read by column
    and is computed once however many plans use it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def arrow_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(rows, schema) whose workers give the memory of past batches back. Arrow's pool keeps it otherwise,
    in each worker, from its largest batch to the end of the application. Batches are of BATCH_BYTES at most (a longer
    row is a batch of its own), unless the session has a limit of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                pool.release_unused()

        try:
            yield from rows(each())
        finally:
            pool.release_unused()

    if df.sparkSession.conf.get(BATCH_SETTING, "1b") == "1b":  # Spark has no such limit for one frame
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for Python workers that do not find it by path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="docslice-code-"), "docslice_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
