"""Vector operators: normalise, exact top-k by cosine, export, and hashed text embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.operators.semantic import dot
from docslice.runtime import arrow_rows, materialise

#: Query vectors of one block; a block is broadcast, so its size is bounded whatever the table's is.
BLOCK = 4096
#: Scores that a task holds at a time.
CELLS = 1 << 20


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(dot(F.col("_v"), F.col("_v")))
    out = vectors.withColumn("_v", v).withColumn("_n", norm)
    return out.withColumn(column, F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v"))).drop("_v", "_n")


def _nearest(ids: list, unit: np.ndarray, k: int, key: str):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_unit = shared.value
        asked = np.array(own_ids, np.int64)
        # a query's k best so far, best first (later ones of equals by key), and what is not filled yet
        scores, names = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
        step = max(1, CELLS // max(1, len(asked)))
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            every = b.column(0).to_numpy()
            unit = _unit(b.column(1).flatten().to_numpy().astype(float).reshape(b.num_rows, -1))
            for a in range(0, b.num_rows, step):
                own = every[a : a + step]
                s = np.round(own_unit @ unit[a : a + step].T, 9)
                s[asked[:, None] == own[None]] = -np.inf
                # most rows reach no query's k-th best: only the others are sorted
                q, r = np.nonzero((s >= scores[:, -1:]) & (s > -np.inf))
                if not len(q):
                    continue
                held = np.flatnonzero(np.bincount(q, minlength=len(asked)))
                q = np.concatenate([q, np.repeat(held, k)])
                v = np.concatenate([s[q[: len(r)], r], scores[held].ravel()])
                name = np.concatenate([own[r], names[held].ravel()])
                by = np.lexsort((name, -v, q))
                q, v, name = q[by], v[by], name[by]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                top = place < k
                scores[q[top], place[top]], names[q[top], place[top]] = v[top], name[top]
        found = scores > -np.inf
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, found.sum(1))), pa.array(names[found]), pa.array(scores[found])], ["query_id", key, "cosine"])

    from pyspark import SparkContext

    shared = SparkContext.getOrCreate().broadcast((ids, unit))
    return best, shared


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, vec_id, rank, cosine: exact nearest vectors of each query among all others. Queries go out in blocks of
    about BLOCK, one after another: the driver and each broadcast hold one block, whatever the number of queries; a task
    keeps the k best of each query, so k rows a query and task are shuffled."""
    n = max(1, -(-queries.count() // BLOCK))
    w, out = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key), None
    for b in range(n):
        q = [(r[0], r[1]) for r in queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b).select(key, column).collect()]
        best, shared = _nearest([i for i, _ in q], _unit(np.array([v for _, v in q], float).reshape(len(q), -1)), k, key)
        part = arrow_rows(vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")), best, f"query_id long, {key} long, cosine double")
        part = part.filter(F.col("cosine") >= -1.5).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
        if n > 1:
            part = materialise(part, "top-k")
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out.select("query_id", key, "rank", F.round("cosine", 6).alias("cosine"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    return x / np.where(n == 0, 1, n)


def export(vectors: DataFrame, payload: list[str], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """JSON records id, vector, payload, as vector stores load them."""
    return vectors.select(F.to_json(F.struct(F.col(key).alias("id"), F.col(column).alias("vector"), F.struct(*payload).alias("payload"))).alias("record"))


def embed_text(chunks: DataFrame, dims: int = 64, text: str = "content", key: str = "doc_id") -> DataFrame:
    """key, embedding: hashed bag-of-words vector of each key's non-blank texts, unit length; an embedder without a
    model. Words are counted by key and coordinate before they are gathered, so at most `dims` counts meet."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = chunks.filter(F.col(text).rlike(r"\S")).select(key, F.explode(words).alias("w"))
    counts = each.groupBy(key, F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("d")).agg(F.count("*").cast("double").alias("n"))
    full = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0)))
    return normalised(full.select(key, vector.alias("embedding")))
