"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the axis of its largest coordinate,
with the sign, is one of 2d codes. A key joins K such codes of one table; the PROBES likeliest keys of each table are
used (second and third axes where they are close), on both sides, so a pair is a candidate in a table if any of its
probes are equal. Candidates are verified by their cosine in double precision.

K grows with the logarithm of the number of vectors, so that buckets stay small; tables and probes grow with K so
that a pair at the threshold is missed less than once in 10,000 times (figures in the README).

Equal vectors (by 128 bits of hash) are one class, with a number of its own, and never meet each other. Keys held by
one class are dropped before anything else moves. Rows of a key over BLOCK are cut into blocks and each pair of blocks
is a task's run. Runs are first sifted on SKETCH sign bits of the same rotations: rows that differ from every other one
of the run in more than FAR bits leave it, which are most of those that met by chance. Pairs at the threshold differ in
a tenth of the bits (26, deviation below 5), so that one is lost so about once in 10**13. Vectors then move to what is
left of the runs. (Vectors of 16 components or fewer are not sifted: their bits depend on each other.) A run gives sums of links and a forest, never its pairs; a pair found under several keys counts under
the smallest one that both vectors have.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; a null vec_id links with nothing, its component is null and it is not kept; rows that
repeat a vec_id are vectors of their own, each with its own links and component; an empty table gives an empty result; labels are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.llm.components import components
from docslice.runtime import arrow_rows, materialise, table

COSINE = 0.95
AXES = 3
BLOCK = 2048
SEED = 7
SKETCH, FAR = 256, 64


def shape(n: int) -> tuple[int, int, int]:
    """Codes of a key, tables and probes for n vectors."""
    k = max(3, math.ceil(math.log(max(2, 40 * n)) / math.log(128)))
    return k, min(60, 10 + 5 * (k - 3)), 4 + 2 * (k - 3)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, not scaled."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=x[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(d, n)


@lru_cache(maxsize=8)
def signs(d: int, k: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, d, k)).choice([-1.0, 1.0], size=(tables, k, 3, d)).astype(np.float32)


@lru_cache(maxsize=8)
def choices(k: int) -> np.ndarray:
    return np.array(list(itertools.product(range(AXES), repeat=k)))


def keys_of(vectors: np.ndarray, k: int, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors: n rows of tables * probes; and sign bits of the first rotations: n rows of SKETCH / 8 bytes."""
    n, own = vectors.shape
    d = 1 << max(2, (own - 1).bit_length())
    x = np.zeros((d, n), np.float32)  # a column each, so that steps of the transform run over many vectors at once
    x[:own] = vectors.T
    out, bits, had = np.empty((n, tables * probes), np.int64), np.zeros((SKETCH, n), bool), 0
    all_choices, each = choices(k), np.arange(n)
    for t in range(tables):
        code, loss = np.empty((k, AXES, n), np.int64), np.empty((k, AXES, n), np.float32)
        for j in range(k):
            y = x
            for s in signs(d, k, tables)[t, j]:
                y = hadamard(y * s[:, None])
            if had < SKETCH and d >= 32:
                some = y[: SKETCH - had]
                bits[had : had + len(some)] = some < 0
                had += len(some)
            size = np.abs(y)
            size /= np.float32(d**1.5)
            for i in range(AXES):
                top = size.argmax(0)
                best = size[top, each]
                if i == 0:
                    most = best
                code[j, i] = top * 2 + (y[top, each] < 0)
                loss[j, i] = (most - best) ** 2
                size[top, each] = -1
        total = sum(loss[j][all_choices[:, j]] for j in range(k))
        pick = np.argsort(total, axis=0, kind="stable")[:probes]
        key = np.zeros((probes, n), np.int64)
        for j in range(k):
            key = key * (2 * d) + code[j][all_choices[pick, j], each]
        # table first, so that keys sort by table; the length keeps vectors of other lengths apart
        out[:, t * probes : (t + 1) * probes] = ((t << 57) | (((key * 0x9E3779B1 + own) ^ (key >> 31)) & ((1 << 57) - 1))).T
    return out, np.packbits(bits, axis=0, bitorder="little").T.copy()


def _first(a: np.ndarray, b: np.ndarray, key: np.ndarray, probes: int) -> np.ndarray:
    """Whether `key` is the smallest that the rows of a and b have in common."""
    ok = np.ones(len(a), bool)
    at = key >> 57
    for t in range(int(at.max(initial=-1)) + 1):
        live = np.flatnonzero(ok & (at >= t))
        x, y = a[live, t * probes : (t + 1) * probes], b[live, t * probes : (t + 1) * probes]
        same = (x[:, :, None] == y[:, None, :]) & (x < key[live][:, None])[:, :, None]
        ok[live[same.any((1, 2))]] = False
    return ok


class Run:
    """Rows of one key and pair of blocks."""

    def __init__(self, probes: int):
        self.probes = probes
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n: list[np.ndarray] = []

    def count(self, who: np.ndarray, n: np.ndarray) -> None:
        self.a.append(who)
        self.b.append(np.full(len(who), -1, np.int64))
        self.n.append(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        self.a.append(x)
        self.b.append(y)
        self.n.append(np.zeros(len(x), np.int64))

    def short(self, run: np.ndarray, block: np.ndarray, cross: np.ndarray, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, codes: np.ndarray, most: int) -> None:
        """Rows of many short runs, one after another: each is compared to the one d further on. In a run of two
        blocks (cross) only rows of different blocks are."""
        for d in range(1, most):
            at = np.flatnonzero((run[d:] == run[:-d]) & (~cross[d:] | (block[d:] != block[:-d])))
            at = at[np.einsum("ij,ij->i", unit[at], unit[at + d]) >= COSINE]
            at = at[_first(codes[at], codes[at + d], key[at], self.probes)]
            self.link(ids[at], ids[at + d])
            self.count(ids[at], sizes[at + d])
            self.count(ids[at + d], sizes[at])

    def long(self, key: int, ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, codes: np.ndarray, left: np.ndarray) -> None:
        """One run; left: rows of the first block if the run is of two, else all rows."""
        cross = not left.all()
        rows, cols = (np.flatnonzero(left), np.flatnonzero(~left)) if cross else (np.arange(len(ids)), np.arange(len(ids)))
        near = unit[rows] @ unit[cols].T >= COSINE
        if not cross:
            np.fill_diagonal(near, False)
        # a forest of all links of the run
        apart, whole = np.ones(len(ids), bool), np.zeros((len(ids), len(ids)), bool)
        whole[np.ix_(rows, cols)] = near
        if cross:
            whole |= whole.T
        for start in range(len(ids)):
            if not apart[start]:
                continue
            apart[start], queue = False, [start]
            while queue:
                one = queue.pop()
                new = np.flatnonzero(whole[one] & apart)
                apart[new] = False
                self.link(np.full(len(new), ids[one]), ids[new])
                queue += new.tolist()
        i, j = np.nonzero(near if cross else np.triu(near))
        i, j = rows[i], cols[j]
        total = np.zeros(len(ids), np.int64)
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            own = _first(codes[x], codes[y], np.full(len(x), key), self.probes)
            np.add.at(total, x[own], sizes[y[own]])
            np.add.at(total, y[own], sizes[x[own]])
        some = np.flatnonzero(total)
        self.count(ids[some], total[some])

    def batch(self) -> pa.RecordBatch:
        none = [np.zeros(0, np.int64)]
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + x)) for x in (self.a, self.b, self.n)], ["a", "b", "n"])
        self.a, self.b, self.n = [], [], []
        return out


def unit_rows(column: pa.ListArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Unit vectors in double precision by their length: row numbers and vectors; columns hold valid vectors only."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        v = flat[starts[at][:, None] + np.arange(d)]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares in range
        out[int(d)] = (at, v / np.sqrt((v * v).sum(axis=1, keepdims=True)))
    return lengths, out


def _hash(batches: Iterator[pa.RecordBatch], k: int, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            some = b.slice(at, 2048)
            n = some.num_rows
            keys, bits = np.empty((n, tables * probes), np.int64), np.empty((n, SKETCH // 8), np.uint8)
            for rows, v in unit_rows(some.column(1))[1].values():
                keys[rows], bits[rows] = keys_of(v, k, tables, probes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (tables * probes)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([some.column(0), lists, pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 8), n, [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())], ["class", "keys", "bits"])


SHORT = 16


def padded(keys: pa.ListArray) -> np.ndarray:
    """Lists of keys as rows of one width; rows bring the keys of the tables up to their own."""
    n = np.diff(keys.offsets.to_numpy())
    out = np.full((len(n), int(n.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = keys.flatten().to_numpy()
    return out


def _verify(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
    """Rows key, x, y, block, class, n, embedding, keys sorted by (key, x, y): sums and a forest of their links."""
    for t in whole_runs(batches):
        run = Run(probes)
        key, x, y, block, ids, sizes = (t.column(c).to_numpy() for c in ("key", "x", "y", "block", "class", "n"))
        by_length = unit_rows(t.column("embedding").combine_chunks())[1]
        codes = padded(t.column("keys").combine_chunks())
        cut = bounds(key, x, y)
        size = np.diff(cut)
        short = np.repeat(size <= SHORT, size)
        for rows, v in by_length.values():
            full = np.zeros((t.num_rows, v.shape[1])) if len(rows) < t.num_rows else v
            if len(rows) < t.num_rows:
                full[rows] = v
            keep = np.intersect1d(np.flatnonzero(short), rows)
            number = np.repeat(np.arange(len(size)), size)
            run.short(number[keep], block[keep], (x != y)[keep], key[keep], ids[keep], sizes[keep], full[keep], codes[keep], min(SHORT, int(size.max())))
            for i in np.flatnonzero(size > SHORT):
                at = np.intersect1d(np.arange(cut[i], cut[i + 1]), rows)
                if len(at):
                    run.long(int(key[at[0]]), ids[at], sizes[at], full[at], codes[at], (block[at] == x[at]))
        yield run.batch()


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by (key, x, y), cut so that no run of equal ones is parted."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(c)[-1].as_py() for c in ("key", "x", "y")]
        same = np.ones(t.num_rows, bool)
        for c, v in zip(("key", "x", "y"), last, strict=True):
            same &= t.column(c).to_numpy() == v
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if whole:
            yield t.slice(0, whole).combine_chunks()
        held, n = t.slice(whole).to_batches(), t.num_rows - whole
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]]))


def sifted(bits: np.ndarray, cut: np.ndarray, block: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Which rows (of runs that begin at cut) differ in at most FAR bits from another one that they are compared to. bits: n rows of
    SKETCH / 64 words."""
    near, size = np.zeros(len(bits), bool), np.diff(cut)
    number, short = np.repeat(np.arange(len(size)), size), np.repeat(size <= SHORT, size)
    for d in range(1, min(SHORT, int(size.max(initial=0)))):
        at = np.flatnonzero((number[d:] == number[:-d]) & short[:-d] & (~cross[d:] | (block[d:] != block[:-d])))
        at = at[np.bitwise_count(bits[at] ^ bits[at + d]).sum(1, dtype=np.int64) <= FAR]
        near[at] = near[at + d] = True
    for i in np.flatnonzero(size > SHORT):
        own = np.arange(cut[i], cut[i + 1])
        left = block[own] == block[own[0]]
        sides = (own[left], own[~left]) if cross[own[0]] else (own, own)
        for a in range(0, len(sides[0]), 256):
            some = sides[0][a : a + 256]
            apart = np.zeros((len(some), len(sides[1])), np.int16)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[some, w][:, None] ^ bits[sides[1], w])
            close = (apart <= FAR) & (some[:, None] != sides[1])
            near[some] |= close.any(1)
            near[sides[1]] |= close.any(0)
    return near


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, x, y, block, class, bits sorted by (key, x, y), less those that are near no other one of their run."""
    for t in whole_runs(batches):
        key, x, y, block = (t.column(c).to_numpy() for c in ("key", "x", "y", "block"))
        raw = t.column("bits").combine_chunks()
        bits = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(len(key), SKETCH // 64)
        keep = t.select(["key", "x", "y", "block", "class"]).filter(pa.array(sifted(bits, bounds(key, x, y), block, x != y)))
        yield from keep.combine_chunks().to_batches()


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # single precision stays so until it is computed with: half of what moves
    kind = vectors.schema[embedding].dataType.simpleString()
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("embedding"))
    base = base.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), v))
    # two hashes of different seeds stand for a vector, so that it need not move to meet its equals
    base = base.withColumns({"h1": F.when(v.isNotNull(), F.xxhash64("embedding")), "h2": F.when(v.isNotNull(), F.xxhash64(F.lit(SEED), "embedding"))})
    classes = base.filter(v.isNotNull()).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "emb-classes")  # numbers hold once they are written
    k, tables, probes = shape(classes.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hash(batches, k, tables, probes)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, probes)

    keys = materialise(arrow_rows(classes.select("class", "embedding"), spread, "class long, keys array<long>, bits binary"), "emb-keys")
    keyed = keys.select("class", F.explode("keys").alias("key"))
    held = materialise(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "emb-held")
    # blocks of a large key meet in pairs, each pair in a run of its own
    met = keyed.join(held, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    met = materialise(met.select("key", "x", "y", "block", "class"), "emb-met")
    place = ["key", "x", "y"]
    sketched = met.join(keys.select("class", "bits"), "class").select(*place, "block", "class", "bits").repartition(*place).sortWithinPartitions(*place)
    near = materialise(arrow_rows(sketched, _sift, "key long, x int, y int, block int, class long"), "emb-near")
    full = near.join(classes.select("class", "n", "embedding").join(keys.select("class", "keys"), "class"), "class")
    # who counts a pair is told by the keys of the tables up to this one; the others need not move
    own = F.slice("keys", F.lit(1), ((F.shiftright("key", 57) + 1) * probes).cast("int"))
    runs = full.select(*place, "block", "class", "n", "embedding", own.alias("keys")).repartition(*place).sortWithinPartitions(*place)
    found = materialise(arrow_rows(runs, verify, "a long, b long, n long"), "emb-found")
    sums = found.filter("b < 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("b >= 0").select("a", "b")).select(F.col("node").alias("class"), "component")
    named = classes.select("class", "h1", "h2", "n", "least").join(sums, "class", "left").join(roots, "class", "left")
    named = materialise(named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("root")), "emb-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "n_links", "component_id")
    out = base.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
