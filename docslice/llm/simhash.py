"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: words of the text with A-Z lower-cased, shingles of SHINGLE words with repeats (fewer words: the whole
sequence), XXH64 of each; a bit is 1 if it is set in over half of the hashes. Without words it is zero and links like
any other.

Linking: distinct fingerprints stand for all documents that have them, so copies never meet each other. The 64 bits are
cut into three segments of 22, 21 and 21 bits, each padded to a word of the perfect binary Golay code [23, 12, 7]. Of
at most 2 errors, one segment has none (pigeonhole), and the next one has 2 at most: both words of that pair lie
within one step of the word midway, so the sets of codewords nearest to all words within one step of either share a
codeword. Each fingerprint so gives, for each error-free segment, that segment and up to six codeword indices of the
next one as keys: about sixteen keys of 33 bits. Fingerprints with a common key are verified by counting bits, in runs
of the sorted key table. In a run, links that only confirm an existing connection are left out: components are exact,
and no run gives more than a few links for each of its rows. Runs over HOT are split by the codewords of the third
segment, whose errors are also 2 at most, so a run is bounded by the code and not by the data.

Defined cases: a null or empty text has fingerprint zero; repeated rows share their fingerprint; null doc_ids are never
the smallest unless a component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.llm.components import components
from docslice.runtime import arrow_rows, materialise, table

SHINGLE, BITS_APART, SEED = 3, 2, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key beyond which the third segment's codewords join the key.
HOT = 512


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text's words, with repeats."""
    words = text.lower().split()  # bytes: A-Z, and [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = list(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))))
    return np.array(hashes, "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's bytes."""
    hashes = shingle_hashes(text, shingle)
    n, ones = len(hashes), np.zeros(64, np.int64)
    if not n:
        return 0
    h = hashes.view(np.uint8)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(h[8 * a : 8 * (a + (1 << 16))].reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a 23-bit word, of single bits, and the error of each syndrome."""
    poly = 0b101011100011

    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= poly << (i - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([remainder(v << 12) for v in range(1 << 11)], np.int32)
    single = np.array([remainder(1 << i) for i in range(23)], np.int32)
    error = np.zeros(1 << 11, np.int32)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return low, high, single, error


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to each 23-bit word and to its 23 neighbours: n rows, 24 columns."""
    low, high, single, error = golay()
    v = v.astype(np.int32)
    syndrome = low[v & 0xFFF] ^ high[v >> 12]
    near = np.empty((len(v), 24), np.int32)
    near[:, 0] = (v ^ error[syndrome]) >> 11
    for i in range(23):
        near[:, i + 1] = (v ^ (1 << i) ^ error[syndrome ^ single[i]]) >> 11
    return near


def _distinct(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the distinct entries of each row."""
    near = np.sort(near, axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(first)
    return row, near[row, col]


def _segment(prints: np.ndarray, k: int) -> np.ndarray:
    at, n = SEGMENTS[k % 3]
    return ((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: kind, the segment without errors, a codeword index of the next segment."""
    rows, keys = [], []
    for k in range(3):
        row, word = _distinct(codewords(_segment(prints, k + 1)))
        rows.append(row)
        keys.append(k << 36 | _segment(prints, k)[row] << 12 | word.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _close(prints: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """A forest that connects what one run's links connect: each round takes a fingerprint and looks for its links
    among those not reached yet."""
    left, out = prints, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= apart
            if near.any():
                reached = left[near]
                out += [(int(one), int(x)) for x in reached]
                queue += list(reached)
                left = left[~near]
    return out


def links_of_runs(keys: np.ndarray, prints: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys of sorted rows."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(cut)
    a, b = [], []
    # short runs: compare each row to the one d further on
    short = np.repeat(size <= 16, size)
    for d in range(1, min(16, int(size.max(initial=1)))):
        same = (keys[d:] == keys[:-d]) & short[:-d]
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= apart]
        a.append(prints[at])
        b.append(prints[at + d])
    for i in np.flatnonzero(size > 16):
        run = prints[cut[i] : cut[i + 1]]
        if len(run) <= HOT:
            found = _close(run, apart)
        else:
            k = int(keys[cut[i]] >> 36)
            row, word = _distinct(codewords(_segment(run, k + 2)))
            order = np.argsort(word, kind="stable")
            row, word = row[order], word[order]
            ends = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
            found = [x for s, e in zip(ends[:-1], ends[1:], strict=True) if e - s > 1 for x in _close(run[row[s:e]], apart)]
        if found:
            x, y = zip(*set(found), strict=True)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, text_hash: bool = False) -> DataFrame:
    """doc_id and print (64 bits as a signed long) of each row; on demand its text_hash as well."""
    more = [F.xxhash64(F.col(text).cast("binary")).alias("text_hash")] if text_hash else []
    names = ["doc_id", "print", "text_hash"][: 2 + len(more)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64)), *b.columns[2:]], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_rows(docs.select(F.col(doc_id), F.col(text).cast("binary"), *more), rows, f"doc_id {kind}, print long" + ", text_hash long" * len(more))


def links(prints: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """a, b: links between distinct fingerprints (column print) that connect all that are at most `apart` bits apart."""
    if apart > BITS_APART:
        raise ValueError("the keys hold for at most 2 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 1 << 13):
                some = own[at : at + (1 << 13)]
                row, key = keys_of(some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row].view(np.int64))], ["key", "print"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            x, y = links_of_runs(k, p, apart)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for b in batches:
            held_k = np.concatenate([held_k, b.column(0).to_numpy()])
            held_p = np.concatenate([held_p, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0  # the last run may go on
            if whole:
                yield made(held_k[:whole], held_p[:whole])
                held_k, held_p = held_k[whole:], held_p[whole:]
        if len(held_k):
            yield made(held_k, held_p)

    keyed = arrow_rows(prints.select("print"), spread, "key long, print long")
    return arrow_rows(keyed.repartition("key").sortWithinPartitions("key"), runs, "a long, b long")


def classes(prints: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """print, root: the class of each fingerprint that has links; the others are classes of their own."""
    found = components(links(prints, apart))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionAll(roots).select(F.col("node").alias("print"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, apart: int = BITS_APART, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print, component_id (smallest doc_id reachable by links) of every row."""
    base = materialise(fingerprints(docs, doc_id, text, shingle), "simhash-prints")
    own = materialise(base.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linked = own.join(classes(own, apart), "print", "left").withColumn("root", F.coalesce("root", "print"))
    linked = materialise(linked, "simhash-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(linked.join(least, "root").select("print", "component_id"), "simhash-named")
    return base.join(named, "print")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, base: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each component: that of the smallest (doc_id, text_hash), ids before nulls.
    base: doc_id, text_hash, node of every row; roots: node, root of the nodes that have links."""
    own = base.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"))
    least = own.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    least = least.select(F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    times = base.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = materialise(least.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("_id", "_hash", "n"), "simhash-kept")
    # texts move once, to the ids; the hash table is built of the ids
    once, more = kept.filter("n = 1"), kept.filter("n > 1")
    same = lambda x: docs["doc_id"].eqNullSafe(x["_id"]) & (F.xxhash64(docs["text"].cast("binary")) == x["_hash"])
    out = docs.join(once.hint("shuffle_hash"), same(once), "left_semi")
    if more.isEmpty():
        return out
    own_hash = unused(docs, "_hash")
    repeated = docs.join(more, same(more), "left_semi").withColumn(own_hash, F.xxhash64(F.col("text").cast("binary")))
    return out.unionAll(repeated.dropDuplicates(["doc_id", own_hash]).drop(own_hash))


def deduplicate(docs: DataFrame, apart: int = BITS_APART, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs, all columns, for each component, whether or not ids are null or used by several texts: that of
    the smallest doc_id, of the smallest text hash among its texts; any of rows that repeat both."""
    base = materialise(fingerprints(docs, shingle=shingle, text_hash=True).withColumnRenamed("print", "node"), "simhash-prints")
    prints = materialise(base.select(F.col("node").alias("print")).distinct(), "simhash-classes")
    return keep_one(docs, base, classes(prints, apart).withColumnRenamed("print", "node"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
