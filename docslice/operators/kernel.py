"""Arrow kernels for chunkers that fold over a text: a function from a text to its chunks, run once a row, batch by
batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docslice.runtime import arrow_rows

SCHEMA = "chunk_index long, content string, size long"


#: Bytes of input for each core below which rows are dealt to all cores first.
SPREAD_BYTES = 32 << 20
#: Bytes of input of a task where a larger input is dealt, files a core from which on it has tasks enough, tasks a core at
#: most, and the size from which on it is not known (rows that come from no file).
TASK_BYTES, FILES, ROUNDS, UNKNOWN = 16 << 20, 4, 256, 1 << 50
#: What deals rows by itself.
DEALT = ("Aggregate", "Join", "Window", "Repartition", "Distinct", "Sort")


def spread(df: DataFrame) -> DataFrame:
    """The input over all cores. A small one (which may be a single row group, so a single task) is dealt row by row. A
    larger one in few files may lie in few row groups as well, so that a core or two would do all the work; it is dealt
    once by a hash of the row, without a sort, into tasks of about TASK_BYTES. Where a plan deals rows by itself, or its
    files are many, they stay. Results are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    n, shape = int(str(plan.stats().sizeInBytes())), plan.toString()
    if "Repartition" in shape:
        return df
    if n < cores * SPREAD_BYTES:
        return df.repartition(cores)
    if n >= UNKNOWN or any(x in shape for x in DEALT) or not 0 < len(df.inputFiles()) < FILES * cores:
        return df
    return df.repartition(cores * min(ROUNDS, -(-n // (cores * TASK_BYTES))), F.xxhash64(*df.columns))


def chunk_rows(df: DataFrame, chunks: Callable[..., Iterable], inputs: list[str], schema: str = "", key: str = "doc_id", most: int = 4000) -> DataFrame:
    """key, chunk_index, content, size and the columns of `schema` for each chunk of each row. chunks: takes the
    values of `inputs` and gives texts, or tuples of a text and the further columns."""
    more = StructType.fromDDL(schema) if schema else StructType()
    own = df.schema[key]
    full = StructType([own, *StructType.fromDDL(SCHEMA), *more])
    arrow = to_arrow_schema(full)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            columns = [b.column(i) for i in range(1, b.num_columns)]
            for i in range(b.num_rows):
                k = b.column(0)[i].as_py()
                for n, got in enumerate(chunks(*(c[i].as_py() for c in columns))):
                    content, *rest = got if isinstance(got, tuple) else (got,)
                    out.append((k, n, content, len(content), *rest))
                if len(out) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return arrow_rows(spread(df.select(F.col(key), *inputs)), rows, full)
