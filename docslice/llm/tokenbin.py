"""Token ids in bit-packed binary files.

Each id takes the fewest bits that hold the vocabulary. A file is a row of blocks and a footer:

    block   the packed ids of BLOCK_IDS ids (the last block of a file may hold fewer), low bits first
    footer  doc ids (int64), lengths (uint32) and block offsets (uint64), then TRAILER

A byte 0x0A follows each block and the footer (the row separator of Spark's text writer, which writes the files, so
that they are committed by task attempt and can go to any store that Spark knows). The trailer has the counts from
which the footer's parts are found, as in columnar formats, so a reader needs the end of a file and then only the
blocks that it wants. Files of a folder follow one another by the numbers in their names, in ascending doc_id order. A
file has FILE_BLOCKS blocks at most (the writer begins another one at a document's start; empty rows fill up the last
blocks, so that Spark's own limit of rows a file cuts where the footer ends), so no key, however hot, makes a file that
is too large to read.

Defined cases: a null text counts as empty and holds the end id alone; null doc_ids come first; rows with the same
doc_id follow each other by the hash of their texts, and can be dealt to several tasks by it; an empty table gives no rows; a document of over BLOCK_IDS * FILE_BLOCKS
ids (268 million) is an error. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.runtime import arrow_rows, materialise, scratch, table

BLOCK_IDS = 1 << 16
FILE_BLOCKS = 4096
#: Bytes of text that a task writes, about.
TASK_BYTES = 32 << 20
UNKNOWN_SIZE = 1 << 60
END_ID = 0
MAGIC = b"DSTB"
#: magic, bits per id, ids per block, blocks, documents, ids, bytes of the footer before the trailer
TRAILER = struct.Struct("<4sIIIQQQ")
NULL_DOC = -(1 << 63)
TOKENIZER = "byte_bpe_50k.json"
#: Before a unit that begins with a line end instead of a space.
MARK = "\x01"


def bits_for(vocab: int) -> int:
    """Fewest bits that hold ids 0 to vocab - 1."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, (n * bits + 7) // 8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide.ravel(), bitorder="little").view("<u4").astype(np.uint32)


class FileWriter:
    """Rows (blocks, then the footer) of one file."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS):
        self.bits, self.block_ids, self.file_blocks = bits, block_ids, file_blocks
        self._begin()

    def _begin(self) -> None:
        self.held: list[np.ndarray] = []
        self.n_held = self.at = self.ids = 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if len(ids) > self.block_ids * self.file_blocks:
            raise ValueError(f"a document of over {self.block_ids * self.file_blocks} ids does not fit in a file")
        if self.docs and len(self.offsets) - (-(self.n_held + len(ids)) // self.block_ids) > self.file_blocks:
            yield from self.finish(True)
            self._begin()
        self.docs.append(NULL_DOC if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= self.block_ids:
            yield from self._flush(False)

    def _flush(self, last: bool) -> Iterator[bytes]:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(flat) if last else len(flat) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            row = pack(flat[a : min(a + self.block_ids, whole)], self.bits)
            self.offsets.append(self.at)
            self.at += len(row) + 1
            yield row
        self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def finish(self, more: bool = False) -> Iterator[bytes]:
        """The last block and the footer; more: another file follows, so empty rows bring this one to its full number."""
        yield from self._flush(True)
        if more:
            yield from [b""] * (self.file_blocks - len(self.offsets))
        body = np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes() + np.array(self.offsets, "<u8").tobytes()
        yield body + TRAILER.pack(MAGIC, self.bits, self.block_ids, len(self.offsets), len(self.docs), self.ids, len(body))


class FileReader:
    """Random access to the ids of one file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        end = len(data) - 1
        magic, self.bits, self.block_ids, blocks, docs, self.ids, body = TRAILER.unpack(self.data[end - TRAILER.size : end])
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = end - TRAILER.size - body
        self.docs = np.frombuffer(self.data, "<i8", docs, at)
        self.lengths = np.frombuffer(self.data, "<u4", docs, at + 8 * docs)
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at + 12 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])

    def block(self, b: int) -> np.ndarray:
        n = min(self.block_ids, self.ids - b * self.block_ids)
        at = int(self.offsets[b])
        return unpack(self.data[at : at + (n * self.bits + 7) // 8], n, self.bits)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file; only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        flat = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return flat[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


class CachedEncoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, which encodes each distinct unit once.

    The pre-tokenizer always cuts before a space that starts a word, so the ids of a text are those of its units (a
    space, or a single line end between words, and what follows up to the next one), one after another. Where white
    space surrounds a space, or a special token may occur, that need not hold and the library gets the whole text.

    Units met once are most of a vocabulary and little of a text, so a full cache drops those that did not come again.
    """

    #: White space as the tokenizers know it, for Arrow's regular expressions.
    SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    WHOLE = rf"{SPACE} (?:{SPACE}|\z)|<\||\x01"
    #: A line end beside other white space is part of a run that the library cuts its own way.
    LINES = rf"\n{SPACE}|{SPACE}\n"
    UNITS, BYTES = 400_000, 32_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.cuts = cuts_at_spaces(path)
        size = self.lib.get_vocab_size()
        self.spaced = np.array([(self.lib.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.lined = np.array([self.lib.id_to_token(i) == "\u010a" for i in range(size)])
        self.keys = pa.array([], pa.string())  # units without their leading space, which all but the first of a text have
        self.flat, self.offsets, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hits = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keep the units met most, at most half of the room."""
        least = 2
        while (self.hits >= least).sum() > self.UNITS // 2:
            least += 1
        keep = self.hits >= least
        if self.keys.nbytes > self.BYTES:
            keep &= pc.binary_length(self.keys).to_numpy() < 64
        at = np.flatnonzero(keep)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        n = int(ends[-1]) if len(ends) else 0
        self.flat = self.flat[np.repeat(self.offsets[at] - (ends - sizes), sizes) + np.arange(n)]
        self.offsets, self.sizes, self.hits = ends - sizes, sizes, self.hits[at] // 2
        self.keys = self.keys.take(pa.array(at))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _side_by_side(self, texts: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of units encoded in long texts: each begins where an id of `start` does. None if one of them
        holds such an id further on."""
        ends = np.unique(np.append(np.arange(0, len(texts), 500), len(texts)))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), "").to_pylist()
        ids = np.fromiter(chain.from_iterable(self._ids(lines)), np.uint32)
        at = np.flatnonzero(start[ids])
        return (ids, np.diff(np.append(at, len(ids)))) if len(at) == len(texts) else None

    def _learn(self, new: pa.Array) -> pa.Array:
        """Add new units, in the order returned. Those without white space at an end are encoded side by side."""
        mark = pc.starts_with(new, MARK)
        core = pc.if_else(mark, pc.utf8_slice_codeunits(new, 2), new)
        odd = pc.match_substring_regex(core, rf"^(?:{self.SPACE}|\z)|{self.SPACE}\z")
        text = pc.if_else(mark, pc.utf8_slice_codeunits(new, 1), pc.binary_join_element_wise("", new, " "))
        parts, left = [], odd
        for kind, start in ((pc.invert(mark), self.spaced), (mark, self.lined)):
            chosen = pc.and_(kind, pc.invert(odd))
            units = new.filter(chosen)
            if not len(units):
                continue
            if got := self._side_by_side(text.filter(chosen), start):
                parts.append((units, *got))
            else:
                left = pc.or_(left, chosen)
        if len(units := new.filter(left)):
            one = self._ids(text.filter(left).to_pylist())
            parts.append((units, np.fromiter(chain.from_iterable(one), np.uint32), np.fromiter(map(len, one), np.int64, len(one))))
        units = pa.concat_arrays([p[0] for p in parts])
        sizes = np.concatenate([p[2] for p in parts])
        self.keys = pa.concat_arrays([self.keys, units])
        self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.flat = np.concatenate([self.flat, *(p[1] for p in parts)])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), np.int32)])
        return units

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Numbers of units; each distinct one is looked up once, and none becomes an object of Python."""
        coded = units.dictionary_encode()
        own = coded.dictionary
        found = pc.index_in(own, value_set=self.keys)
        idx = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            n, missed = len(self.keys), own.filter(pc.is_null(found))
            idx[idx < 0] = n + pc.index_in(missed, value_set=self._learn(missed)).to_numpy()
        numbers = idx[coded.indices.to_numpy()]
        self.hits += np.bincount(numbers, minlength=len(self.hits)).astype(np.int32)
        return numbers

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return [np.array(x, np.uint32) for x in self._ids(texts.to_pylist())]
        if len(self.keys) > self.UNITS or self.keys.nbytes > self.BYTES:
            self._trim()
        whole = pc.match_substring_regex(texts, self.WHOLE)
        lines = pc.or_(whole, pc.match_substring_regex(texts, self.LINES))
        # a line end between words starts a unit as well
        marked = pc.if_else(lines, texts, pc.replace_substring(texts, "\n", f" {MARK}\n"))
        parts = pc.split_pattern(pc.if_else(whole, "", marked), " ")
        offsets, flat = parts.offsets.to_numpy(), parts.flatten()
        offsets = offsets - offsets[0]
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        heads = pc.if_else(whole, texts, flat.take(pa.array(offsets[:-1]))).to_pylist()
        idx = self._numbers(flat.filter(pa.array(~first)))
        sizes = self.sizes[idx]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.offsets[idx] - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[offsets - np.arange(len(offsets))]  # each text before has one head, which is no unit
        return [np.concatenate([np.array(h, np.uint32), ids[a:z]]) for h, a, z in zip(self._ids(heads), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose pre-tokenizer alone decides where words are cut, and which
    changes no text before it: what CachedEncoder relies on. Others get whole texts by the library."""
    with open(path, encoding="utf-8") as f:  # a file that all executors have
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("model", {}).get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", False)
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


@lru_cache(maxsize=2)
def encoder_of(path: str) -> CachedEncoder:
    """One encoder for all tasks of a Python worker."""
    return CachedEncoder(path)


def _parts(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts in runs of about so many bytes of text, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    n = 0

    def made() -> tuple[list, pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.column(0).to_pylist(), pa.concat_arrays(t.column(1).chunks)

    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            base = int(upto[a - 1]) if a else 0
            z = min(b.num_rows, int(np.searchsorted(upto, base + size - n)) + 1)
            held.append(b.slice(a, z - a))
            n += int(upto[z - 1]) - base
            a = z
            if n >= size:
                yield made()
                held, n = [], 0
    if held:
        yield made()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> int:
    """Write doc_id, text rows to token files under path; returns the bits of an id. tokenizer: a file of the
    tokenizers library that all executors have."""
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileWriter(bits)
        end = np.array([end_id], np.uint32)

        def batch(data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["value"])

        encoder = encoder_of(tokenizer)
        for some, part in _parts(batches):
            for doc, x in zip(some, encoder.encode(part), strict=True):
                if made := list(out.add(doc, np.concatenate([x, end]))):
                    yield batch(made)
        if out.docs:
            for r in out.finish():
                yield batch([r])

    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_SIZE:  # what Spark says of inputs that it has no statistics of
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    key = [F.coalesce(F.col("doc_id"), F.lit(NULL_DOC)), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, *key).sortWithinPartitions(*key)
    packed = arrow_rows(ordered, rows, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", FILE_BLOCKS + 1).text(path)
    return bits


def _document_rows(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """file, doc_id, at, n_tokens, ids_crc32, bits of each document of a file."""
    if len(data) <= TRAILER.size:  # a task without rows leaves an empty file
        return
    f = FileReader(data)
    crc, block, flat = [], -1, np.zeros(0, np.uint32)
    for a, z in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True):
        b = a // f.block_ids
        if b == (z - 1) // f.block_ids:
            if block != b:
                block, flat = b, f.block(b)
            ids = flat[a - b * f.block_ids : z - b * f.block_ids]
        else:
            ids = f.read(a, z)
        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(crc), pa.string()),
            pa.array([None if x == NULL_DOC else x for x in f.docs.tolist()], pa.int64()),
            pa.array(f.starts[:-1], pa.int64()),
            pa.array(f.lengths.astype(np.int64), pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array([f.bits] * len(crc), pa.int32()),
        ],
        ["file", "doc_id", "at", "n_tokens", "ids_crc32", "bits"],
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and bits of each document, from the files."""
    files = spark.read.format("binaryFile").load(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _document_rows(name, data.as_py())

    rows = arrow_rows(files.select("path", "content"), documents, "file string, doc_id long, at long, n_tokens long, ids_crc32 long, bits int")
    # a file's place: its task's number, then its own among those of the task
    number = lambda p: F.regexp_extract("file", p, 1).cast("long")
    rows = materialise(rows.withColumns({"part": number(r"part-(\d+)"), "nth": F.coalesce(number(r"-c(\d+)"), F.lit(0))}).drop("file"), "token-rows")
    # ids before a file: those of earlier stretches of files, and of earlier ones in its own
    counts = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("ids")).withColumn("stretch", F.floor(F.col("part") / 1024))
    earlier = lambda *by: F.coalesce(F.sum("ids").over((Window.partitionBy(*by[:-1]) if by[:-1] else Window).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("stretch").agg(F.sum("ids").alias("ids")).select("stretch", earlier(["stretch"]).alias("past"))
    starts = counts.withColumn("own", earlier("stretch", ["part", "nth"])).join(stretches, "stretch").select("part", "nth", (F.col("past") + F.col("own")).alias("before"))
    return rows.join(starts, ["part", "nth"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "bits")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write documents as token files in the shared folder, and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return read_tokens(spark, path)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
