"""Token counts and token windows by files of the tokenizers library, batch by batch in Arrow."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docslice.operators.kernel import spread
from docslice.runtime import arrow_rows


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer for all tasks of a Python worker. path: a file that all executors have. A task has one core, so the
    library's own threads are off: each of them would hold memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens: tokens of the whole text (null: none), without special ones."""
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [len(tokenizer(path).encode_batch_fast([t or ""], add_special_tokens=False)[0]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], [*b.schema.names, "n_tokens"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_rows(docs, rows, f"{kind}, n_tokens long")


def _spans(batches: Iterator[pa.RecordBatch], path: str, size: int, overlap: int, key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for r, t in enumerate(b.column(1).to_pylist()):
            # one text at a time: an encoding takes some hundred times the text's bytes
            t = t or ""
            places = tokenizer(path).encode(t, add_special_tokens=False).offsets
            for k, a in enumerate(range(0, len(places), size - overlap)):
                if k and a + overlap >= len(places):
                    break
                z = min(a + size, len(places))
                for column, v in zip(out, (r, k, t[places[a][0] : places[z - 1][1]], z - a), strict=True):
                    column.append(v)
        content = pa.array(out[2], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), content, pa.array([len(c) for c in out[2]], pa.int64()), pa.array(out[3], pa.int64())], [key, "chunk_index", "content", "size", "n_tokens"])


def token_spans(docs: DataFrame, path: str, size: int, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, chunk_index, content, size, n_tokens: exact windows of tokens, cut from the text at the tokens' own places."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    own = spread(docs.select(F.col(key), F.col(text)))
    return arrow_rows(own, partial(_spans, path=path, size=size, overlap=overlap, key=key), f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index long, content string, size long, n_tokens long")
