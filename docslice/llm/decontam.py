"""Benchmark decontamination with suffix arrays of the training text.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII. Training texts are dealt
with in shards, each a run of rows of a partition. For a shard, a sparse suffix array holds the suffixes that can
start a match (their first words are a pair, then a run of four, of the benchmark; short items keep single words),
sorted by their first WINDOW words. Every test suffix is found by binary search in it: the interval gives all places
where its first WINDOW words (all of a shorter item) stand verbatim. Matches on one diagonal that follow one another
join to the longest verbatim matches, with their places. Words are numbered exactly by a dictionary of the benchmark's
words; hashes are only used to leave suffixes out early, never to accept a match.

The benchmark is cut into blocks of about BLOCK_BYTES of text. One block (the usual case) is broadcast, and each document
is judged in one pass. Of several, each is broadcast alone, meets all documents in a pass of its own that writes a
narrow table of hits, and is destroyed before the next one is sent: memory of driver and workers is that of one block
(about 60 times its text, and 13 MB), however large the benchmark is; the number of passes grows with it.

Defined cases: a null or empty text has no words and is clean; an item without words has no windows; items of equal id
count once; a null item id counts as the empty string; an empty benchmark leaves all clean; repeated rows are judged
each for itself; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.runtime import arrow_rows, materialise, table

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BITS = 22
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_KEEP).split()


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _rows(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The width ids from each position on, as byte strings that sort as the ids do; ids must have width zeros at the end."""
    return np.ascontiguousarray(ids[at[:, None] + np.arange(width)].astype(">u4")).view(f"S{4 * width}").ravel()


class Tests:
    """Test suffixes of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        seen: dict[bytes, dict[int, None]] = {}  # window bytes: items
        self.names = [name for name, _ in items]
        starts: dict[bytes, list[tuple[int, int]]] = {}
        arrays = []
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64)
            arrays.append(ids)
            n = min(window, len(ids))
            if n:
                raw = np.ascontiguousarray(ids.astype(">u4")).tobytes()
                for p in range(len(ids) - n + 1):
                    w = raw[4 * p : 4 * (p + n)]
                    seen.setdefault(w, {})[k] = None
                    starts.setdefault(w, []).append((k, p))
        self.windows = list(seen)
        self.size = np.array([len(w) // 4 for w in self.windows], np.int64)
        self.items = [list(x) for x in seen.values()]
        self.starts = [starts[w] for w in self.windows]
        wide = 4 * window
        self.low = np.array([w.ljust(wide, b"\0") for w in self.windows], f"S{wide}")
        self.high = np.array([w.ljust(wide, b"\xff") for w in self.windows], f"S{wide}")
        # filters of the first one, two and four words: a suffix passes if it may be the start of a window so long
        self.one = np.zeros(len(self.vocab) + 1, bool)
        self.two, self.four = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        self.short2 = np.zeros(len(self.vocab) + 1, bool)
        self.short4 = np.zeros(1 << _BITS, bool)
        first = np.zeros((len(self.windows), 4), np.int64)
        for i, w in enumerate(self.windows):
            ids = np.frombuffer(w, ">u4")[:4]
            first[i, : len(ids)] = ids
        if len(first):
            self.one[first[:, 0]] = True
            self.two[_mix(first[:, 0], first[:, 1])] = True
            self.four[_mix(*first.T)] = True
            self.short2[first[self.size < 2, 0]] = True
            some = first[(self.size >= 2) & (self.size < 4)]
            self.short4[_mix(some[:, 0], some[:, 1])] = True

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, windows) of all matches in a shard's ids, which end in `window` zeros."""
        at = np.flatnonzero(self.one[ids[: len(ids) - self.window]])
        a, b = ids[at], ids[at + 1]
        pair = _mix(a, b)
        at = at[self.two[pair] | self.short2[a]]
        a, b = ids[at], ids[at + 1]
        at = at[self.four[_mix(a, b, ids[at + 2], ids[at + 3])] | self.short2[a] | self.short4[_mix(a, b)]]
        if not len(at) or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _rows(ids, at, self.window)
        order = np.argsort(keys, kind="stable")  # the shard's sparse suffix array
        keys, at = keys[order], at[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], which


def _shards(texts: pa.Array, most: int = SHARD_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of each run of rows of about so many bytes."""
    a, n, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.as_py() or b"")
        n += len(held[-1])
        if n >= most:
            yield a, held
            a, n, held = i + 1, 0, []
    if held:
        yield a, held


class Shard:
    """Words of a run of texts."""

    def __init__(self, texts: list[bytes]):
        self.words = [words_of(t) for t in texts]
        self.n_words = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1]  # a zero between texts

    def ids(self, tests: Tests) -> np.ndarray:
        out = np.zeros(int((self.n_words + 1).sum()) + tests.window, np.int64)
        get, zeros = tests.vocab.get, [0] * int(self.n_words.max(initial=0))
        for a, w in zip(self.starts.tolist(), self.words, strict=True):
            out[a : a + len(w)] = list(map(get, w, zeros))
        return out

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def judge(texts: list[bytes], blocks: list) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """n_words, n_hit and the sorted item names of each text."""
    shard = Shard(texts)
    marks = np.zeros(int((shard.n_words + 1).sum()) + 1, np.int64)
    found: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        tests = block.value
        at, which = tests.find(shard.ids(tests))
        np.add.at(marks, at, 1)
        np.add.at(marks, at + tests.size[which], -1)
        pairs = np.unique(shard.row_of(at) * max(1, len(tests.windows)) + which)
        for row, w in zip((pairs // max(1, len(tests.windows))).tolist(), (pairs % max(1, len(tests.windows))).tolist(), strict=True):
            found[row].update(tests.names[k] for k in tests.items[w])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    return shard.n_words, hit[shard.starts + shard.n_words] - hit[shard.starts], [sorted(x) for x in found]


def split_tests(bench: DataFrame, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", text: str = "text") -> list[DataFrame]:
    """The benchmark's items (item, body) in blocks of about block_bytes of text."""
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k) for k in range(n)]


def send(block: DataFrame, window: int = WINDOW) -> object:
    """Broadcast test suffixes of one block."""
    return block.sparkSession.sparkContext.broadcast(Tests([(r["item"], bytes(r["body"])) for r in block.collect()], window))


def judged(docs: DataFrame, tests: object) -> DataFrame:
    """key columns of docs (all but its last, the text), and n_words, n_hit, items of each row, by one broadcast block."""
    keys = docs.columns[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in _shards(b.column(len(keys))):
                n_words, n_hit, items = judge(texts, [tests])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(texts)) for c in b.columns[: len(keys)]), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], [*keys, "n_words", "n_hit", "items"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_rows(docs, rows, f"{kinds}, n_words long, n_hit long, items array<string>")


def _hits(docs: DataFrame, tests: object) -> DataFrame:
    """_id, _hash, n_words, from, to, item: spans of hit words, and items found, of each row with hits; a row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in _shards(b.column(2)):
                shard, own = Shard(texts), tests.value
                at, which = own.find(shard.ids(own))
                row = shard.row_of(at)
                start = at - shard.starts[row]
                found = {(r, p, int(own.size[w]), own.names[k]) for r, p, w in zip(row.tolist(), start.tolist(), which.tolist(), strict=True) for k in own.items[w]}
                if found:
                    r, p, n, item = zip(*sorted(found), strict=True)
                    take = pa.array([a + x for x in r])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(shard.n_words[list(r)]), pa.array(p, pa.int64()), pa.array(np.add(p, n)), pa.array(item, pa.string())], ["_id", "_hash", "n_words", "from", "to", "item"])

    kind = docs.schema["_id"].dataType.simpleString()
    return arrow_rows(docs, rows, f"_id {kind}, _hash long, n_words long, `from` long, `to` long, item string")


def _totals(docs: DataFrame, blocks: list[DataFrame], doc_id: str, text: str) -> DataFrame:
    """_id, _hash, n_words, n_hit, items of the rows with hits of any block, a pass for each block."""
    body = F.col(text).cast("binary")
    own, found = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_hash"), body.alias("_text")), None
    for block in blocks:
        tests = send(block)
        some = materialise(_hits(own, tests).distinct(), "decontam-hits")  # rows that repeat count once
        tests.destroy()
        found = some if found is None else found.unionAll(some)
    # words hit: spans joined where they meet, in the order of their starts
    order = Window.partitionBy("_id", "_hash").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    spans_ = found.select("_id", "_hash", "n_words", "from", "to").distinct()
    before = F.coalesce(F.max("to").over(order), F.lit(0))
    hit = spans_.withColumn("more", F.greatest(F.lit(0), F.col("to") - F.greatest("from", before))).groupBy("_id", "_hash").agg(F.max("n_words").alias("n_words"), F.sum("more").alias("n_hit"))
    items = found.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = [F.col("a._id").eqNullSafe(F.col("b._id")), F.col("a._hash") == F.col("b._hash")]
    return hit.alias("a").join(items.alias("b"), same).select("a._id", "a._hash", "n_words", "n_hit", "items")


def score(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    blocks = split_tests(bench, block_bytes)
    body = F.col(text).cast("binary")
    if len(blocks) == 1:
        found = judged(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")), send(blocks[0]))
    else:
        totals = materialise(_totals(docs, blocks, doc_id, text), "decontam-totals")
        words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")  # no run of word bytes is parted by lower-casing
        own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("own_hash"), words.alias("n_words"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_hash"))
        found = own.join(totals.drop("n_words"), same, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def spans(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Longest verbatim matches: doc_id, item, doc_start, item_start, n_words (places in words). A match is as long as
    its windows follow one another on one diagonal; items whose text repeats a window give a match for each place."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def found(tests_: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, texts in _shards(b.column(1)):
                    shard, out = Shard(texts), []
                    tests = tests_.value
                    at, which = tests.find(shard.ids(tests))
                    hits = [(int(r), k, p - q, p, q, int(tests.size[w])) for r, p, w in zip(shard.row_of(at), at.tolist(), which.tolist(), strict=True) for k, q in tests.starts[w]]
                    hits.sort()
                    run = None
                    for r, k, d, p, q, n in [*hits, (-1, 0, 0, 0, 0, 0)]:
                        if run and run[:3] == (r, k, d) and p == run[5] + 1:
                            run = (*run[:5], p, n)
                        else:
                            if run:
                                out.append((run[0], tests.names[run[1]], run[3] - int(shard.starts[run[0]]), run[4], run[5] + run[6] - run[3]))
                            run = (r, k, d, p, q, p, n)
                    if out:
                        row, item, start, item_start, size = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([a + r for r in row])), pa.array(item, pa.string()), *(pa.array(x, pa.int64()) for x in (start, item_start, size))], ["doc_id", "item", "doc_start", "item_start", "n_words"])

        return rows

    own, out, blocks = docs.select(F.col(doc_id), F.col(text).cast("binary")), None, split_tests(bench)
    for block in blocks:
        tests = send(block)
        some = arrow_rows(own, found(tests), f"doc_id {kind}, item string, doc_start long, item_start long, n_words long")
        if len(blocks) > 1:
            some = materialise(some, "decontam-spans")
            tests.destroy()
        out = some if out is None else out.unionAll(some)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, min_share: float = 0.0, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark. min_share: rows stay as well whose hit words
    are less than that share of their words."""
    blocks, at = split_tests(bench, block_bytes), docs.columns.index(text)
    if len(blocks) > 1:
        totals = _totals(docs, blocks, doc_id, text)
        bad = materialise(totals.filter(F.col("n_hit") >= min_share * F.col("n_words")).select("_id", "_hash"), "decontam-bad")
        return docs.join(bad, docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text].cast("binary")) == bad["_hash"]), "left_anti")
    tests = send(blocks[0])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in _shards(b.column(at).cast(pa.binary())):
                n_words, n_hit, _ = judge(texts, [tests])
                yield b.slice(a, len(texts)).filter(pa.array((n_hit == 0) | (n_hit < min_share * n_words)))

    return arrow_rows(docs, rows, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
