"""Near-duplicates by similarity of shingle sets: SimHash and MinHash bands find pairs, the sets themselves decide.

SimHash links fingerprints as op8 does (Golay-code keys, 2 of 64 bits); sets whose texts have connected fingerprints are
compared, so no pair within 2 bits is missed. It can't serve alone: texts whose sets of shingles have a Jaccard similarity
of 0.8 differ in about 10 bits, and no key holds for that many. Each distinct set so gives BANDS more keys of ROWS least
hashes; two sets of similarity s share none of these with probability (1 - s^ROWS)^BANDS: 0.00003 at 0.8, less above.
Sets with a common key (a run) are compared exactly, on 32-bit hashes of all their shingles.

Equal sets are folded to one class first. Runs of the same members are compared once. Runs over BLOCK are cut into
blocks that each hold the run's first class as well; classes that its component does not reach in the first round meet
every block in a second one, WIDE blocks at a time. So every pair of a run is compared unless it is connected already.

Defined cases: words are split and lower-cased as for SimHash; a text of fewer words than a shingle is one shingle; null
texts and texts without words are equal to each other and to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docslice.llm import simhash
from docslice.llm.components import components
from docslice.llm.simhash import SEED, fingerprint, keep_one, shingle_hashes
from docslice.runtime import arrow_rows, materialise

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 20
#: Classes of a block that runs are cut into, and blocks that meet as one in the second round.
BLOCK, WIDE = 128, 4
_R = np.random.default_rng(SEED)
TURNS = _R.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _R.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of 64-bit hashes."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (TURNS[:, None] * hashes[None, at : at + (1 << 12)]).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row (unique), doc_id, text_hash, node (the class), bands, shingles (32-bit hashes) and print (op8's fingerprint) of
    each row."""
    none = np.zeros(0, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, sets, prints = [], [], [], np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(b.column(3)):
                text = t.as_py() or b""
                prints[i] = fingerprint(text)
                h = np.unique(shingle_hashes(text, shingle))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63))
                keys.append(bands(h) if len(h) else none)
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32())), pa.array(prints.view(np.int64))],
                ["row", "doc_id", "text_hash", "node", "bands", "shingles", "print"],
            )

    text = F.col("text").cast("binary")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return arrow_rows(own, rows, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, bands array<long>, shingles array<int>, print long")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by their first column, cut so that no run of equal keys is parted, with the bounds of their runs."""
    held: list[pa.RecordBatch] = []

    def made(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        return b, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if at or (held and held[-1].column(0)[-1].as_py() != key[-1]):
            yield made([*held, *([b.slice(0, at)] if at else [])])
            held = []
        held.append(b.slice(at))
    if held:
        yield made(held)


def _members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """run (a hash of its members), block, node, first (the run's first class), hot of the runs with several classes."""
    for b, cut in whole_runs(batches):
        out: list[list[np.ndarray]] = []
        nodes = b.column(1).to_numpy()
        for i in np.flatnonzero(np.diff(cut) > 1):
            own = np.unique(nodes[cut[i] : cut[i + 1]])
            n = len(own)
            if n < 2:
                continue
            block = np.arange(n) // most
            more = np.arange(1, block[-1] + 1)  # the first class is in every block
            name = xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)
            size = n + len(more)
            out.append([np.full(size, name), np.concatenate([block, more]), np.concatenate([own, np.full(len(more), own[0])]), np.full(size, own[0]), np.full(size, n > most)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["run", "block", "node", "first", "hot"])


def alike(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A forest that connects what the links among sets connect; flat: the sets one after another."""
    values, place = np.unique(flat, return_inverse=True)
    starts, left, out = np.cumsum(sizes) - sizes, np.arange(1, len(sizes)), []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        one = queue.pop()
        mark = np.zeros(len(values), np.int64)
        mark[place[starts[one] : starts[one] + sizes[one]]] = 1
        shared = np.add.reduceat(mark[place], starts)[left]
        near = shared >= similarity * (sizes[left] + sizes[one] - shared) - 1e-9
        out += [(one, int(x)) for x in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return out


def _meet(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links among the classes (node) of each group (g)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cut in whole_runs(batches):
            a, z = [], []
            nodes, sizes, flat = b.column(1).to_numpy(), b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1:
                    for x, y in alike(flat[ends[s] : ends[e]], sizes[s:e].astype(np.int64), similarity):
                        a.append(nodes[s + x])
                        z.append(nodes[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    full = groups.join(sets, "node").select("g", "node", "shingles")
    return materialise(arrow_rows(full.repartition("g").sortWithinPartitions("g"), rows, "a long, b long"), "shingles-links")


def print_keys(base: DataFrame) -> DataFrame:
    """key, node: the classes of sketches by the components of their texts' fingerprints under SimHash links."""
    own = materialise(base.filter(F.size("bands") > 0).select("print", "node").distinct(), "shingles-prints")
    linked = own.join(simhash.classes(own.select("print").distinct()), "print", "left")
    return linked.select(F.coalesce("root", "print").alias("key"), "node")


def classes(base: DataFrame, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """node, root: the component of each class of sketches that has links; the others are components of their own. more:
    keys (key, node) besides the bands."""
    least = base.filter(F.size("bands") > 0).groupBy("node").agg(F.min("row").alias("row"))
    heads = materialise(base.select("row", "node", "bands").join(least.select("row"), "row", "left_semi"), "shingles-heads")
    keyed = heads.select(F.explode("bands").alias("key"), "node")
    keyed = keyed if more is None else keyed.unionAll(more)
    found = arrow_rows(keyed.repartition("key").sortWithinPartitions("key"), partial(_members, most=BLOCK), "run long, block long, node long, first long, hot boolean")
    members = materialise(found.distinct(), "shingles-members")
    # each class's set moves by its row's number, which no other row has
    wanted = heads.select("row", "node").join(members.select("node").distinct(), "node", "left_semi").select("row")
    sets = materialise(base.select("row", "node", "shingles").join(wanted, "row", "left_semi").drop("row"), "shingles-sets")
    links = _meet(members.select(F.xxhash64("run", "block").alias("g"), "node").distinct(), sets, similarity)
    tree = components(links)
    hot = members.filter("hot")
    if not hot.isEmpty():
        left = _unreached(hot, tree)
        if not left.isEmpty():
            hot = hot.withColumn("block", F.floor(F.col("block") / WIDE))
            chunks, blocks = left.select("run", "chunk").distinct(), hot.select("run", "block").distinct()
            g = F.xxhash64("run", "block", "chunk").alias("g")
            both = hot.join(chunks, "run").select(g, "node").unionAll(left.join(blocks, "run").select(g, "node"))
            tree = components(links.unionAll(_meet(both.distinct(), sets, similarity)))
    tree = materialise(tree.select(F.col("node"), F.col("component").alias("root")), "shingles-roots")
    return tree.unionAll(tree.select(F.col("root").alias("node"), "root").distinct())


def _unreached(hot: DataFrame, tree: DataFrame) -> DataFrame:
    """run, node, chunk: the classes of hot runs that the first class's component does not hold."""
    own = hot.select("run", "node", "first").distinct()
    roots = tree.select("node", F.col("component").alias("root"))
    firsts = own.select("run", "first").distinct().join(roots.withColumnRenamed("node", "first"), "first", "left").select("run", F.coalesce("root", "first").alias("reached"))
    left = own.join(firsts, "run").join(roots, "node", "left").filter(F.coalesce("root", "node") != F.col("reached"))
    left = materialise(left.select("run", "node"), "shingles-unreached")
    many = left.groupBy("run").agg(F.ceil(F.count("*") / (BLOCK * WIDE)).alias("chunks"))
    return left.join(many, "run").select("run", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs, all columns, for each component of texts that are similar, as simhash.keep_one chooses it."""
    base = materialise(sketches(docs, shingle), "shingles-base")
    return keep_one(docs, base.select("doc_id", "text_hash", "node"), classes(base, similarity, print_keys(base)))
