"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Patterns are nodes with a
capacity of their size per repetition; the k-th repetition costs k - 1 a word (convex, so a flow fills whole passes
before it repeats). Sources are nodes with a quota. Successive shortest paths, all of one cost at a time, route
capacity to quotas, whether patterns overlap or not; the flow through a pattern says how often it is read: `floor` whole passes for all its documents, and one more for a part.
That part is chosen by seeded hash order up to the wanted words, to the nearest document.

The flow network has a node per pattern and per source and is bounded by `max_patterns`, checked before anything is
collected. Selection runs on histograms of the seeded hash, so no source is sorted in one task.

Defined cases: a null text has size 0; null is a source of its own, sorted last; documents of size 0 are never taken;
an empty table gives an empty result; repeated rows are rows of their own. If quotas exceed what `max_repeats` passes
give, targets are capped and the excess is dealt out again by weight.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.llm.simhash import unused
from docslice.runtime import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Histogram cells of the seeded hash, per pattern.
CELLS = 1 << 12
MAX_PATTERNS = 100_000
SEED = 20240229


def targets(sizes: dict, weights: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Target of each source: its weight's share of all sizes, at most max_repeats times its own size; the excess
    goes to the others by weight until none is above."""
    left, open_, out = Fraction(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] > max_repeats * sizes[s] * total}
        if not over:
            out |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(max_repeats * sizes[s])
            left -= out[s]
        open_ -= over
    return out


class Network:
    """Maximum flow by layers (Dinic), without recursion. Capacities are whole numbers of any size."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int) -> int:
        """Number of a new arc; the next number is that of its way back."""
        self.to += [b, a]
        self.room += [room, 0]
        self.arcs[a].append(len(self.to) - 2)
        self.arcs[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def _layers(self, start: int, end: int) -> list[int]:
        layer = [-1] * len(self.arcs)
        layer[start], now = 0, [start]
        while now and layer[end] < 0:
            after = []
            for a in now:
                for e in self.arcs[a]:
                    b = self.to[e]
                    if self.room[e] and layer[b] < 0:
                        layer[b] = layer[a] + 1
                        after.append(b)
            now = after
        return layer

    def fill(self, start: int, end: int) -> None:
        while True:
            layer = self._layers(start, end)
            if layer[end] < 0:
                return
            at, path, node = [0] * len(self.arcs), [], start
            while True:
                if node == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    node = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs = self.arcs[node]
                while at[node] < len(arcs):
                    e = arcs[at[node]]
                    if self.room[e] and layer[self.to[e]] == layer[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(arcs):
                    path.append(e)
                    node = self.to[e]
                elif path:  # a dead end
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple[tuple, object], int]:
    """Words of each pattern that go to each source. patterns: capacity by tuple of sources; the k-th pass costs
    k - 1 a word.

    A shortest path through the network costs what the next pass of the pattern that it starts from does: re-routing
    other patterns changes nothing in how often they are read. So successive shortest paths use all paths of the first
    pass, then those of the second, and so on: a maximum flow for each pass, on top of the one before."""
    own = sorted((p for p, size in patterns.items() if size and p), key=repr)
    sources = sorted({s for p in own for s in p}, key=lambda s: (s is None, str(s)))
    place = {s: 1 + len(own) + i for i, s in enumerate(sources)}
    start, end = 0, 1 + len(own) + len(sources)
    net = Network(end + 1)
    passes = [net.arc(start, 1 + i, 0) for i in range(len(own))]
    most = sum(patterns.values()) * max_repeats
    arcs = [(p, s, net.arc(1 + i, place[s], most)) for i, p in enumerate(own) for s in dict.fromkeys(p)]
    for s in sources:
        net.arc(place[s], end, quotas.get(s, 0))
    for _ in range(max_repeats):
        for p, e in zip(own, passes, strict=True):
            net.room[e] += patterns[p]
        net.fill(start, end)
    return {(p, s): net.room[e ^ 1] for p, s, e in arcs if net.room[e ^ 1]}


def mix(docs: DataFrame, weights=None, max_repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs: doc_id, size and memberships (array of sources, one for each source that holds the document). weights:
    a function from the sorted list of sources to their weights; none: 5, 2, 1 repeating. Returns docs with
    source_size and target (of the first membership), repeats and taken."""
    spark = docs.sparkSession
    weigh = weights or (lambda names: [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    docs = docs.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 40)))
    base = materialise(docs, "mix-base")
    # the hash is cut in cells, counted per pattern in one pass; patterns come from the counts
    width = (1 << 40) // CELLS
    cells = materialise(base.groupBy("memberships", F.floor(F.col("cell") / width).cast("int").alias("slice")).agg(F.sum("size").alias("words")), "mix-cells")
    by_pattern = cells.groupBy("memberships").agg(F.sum("words").alias("words"))
    found = by_pattern.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; coarsen the sources or raise max_patterns")
    patterns = {tuple(r["memberships"]): r["words"] for r in found}
    own: dict = {}
    for p, words in patterns.items():
        for s in p:
            own[s] = own.get(s, 0) + words
    names = sorted((s for s in own if s is not None), key=str) + [None] * (None in own)
    weight = dict(zip(names, weigh(names), strict=True))
    # a document that several sources hold counts once in what there is to share
    total = sum(patterns.values())
    target = targets(own, weight, max_repeats) if total == sum(own.values()) else {s: v * Fraction(total, max(1, sum(own.values()))) for s, v in targets(own, weight, max_repeats).items()}
    flow = min_cost_flow(patterns, {s: round(v) for s, v in target.items()}, max_repeats)
    taken: dict = {}
    for (p, _), amount in flow.items():
        taken[p] = taken.get(p, 0) + amount
    plan = []
    for p, words in patterns.items():
        passes = taken.get(p, 0) // words if words else 0
        plan.append((list(p), int(passes), int(taken.get(p, 0) - passes * words), own[p[0]] if p else 0, float(target[p[0]]) if p else 0.0))
    kind = docs.schema["memberships"].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"memberships {kind}, passes int, part long, source_size long, target double")
    # the slice in which the wanted part ends, then the row in it: words before a row plus half of its own
    same = F.col("c.memberships").eqNullSafe(F.col("p.memberships"))
    before = F.sum("words").over(Window.partitionBy("memberships").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    edges = cells.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(plan.alias("p"), same).filter((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("words"))).select("c.memberships", "slice", "before")
    plan = materialise(plan.alias("c").join(edges.alias("p"), same, "left").select("c.*", "slice", "before"), "mix-plan")
    rows = base.withColumn("own_slice", F.floor(F.col("cell") / width).cast("int")).alias("d").join(plan.alias("p"), F.col("d.memberships").eqNullSafe(F.col("p.memberships"))).select("d.*", "passes", "part", "source_size", "target", "slice", "before")
    first = rows.filter(F.coalesce(F.col("own_slice") != F.col("slice"), F.lit(True))).withColumn("more", (F.col("own_slice") < F.col("slice")).cast("int"))
    order = Window.partitionBy("memberships").orderBy("cell", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.filter(F.col("own_slice") == F.col("slice")).withColumn("upto", F.sum("size").over(order))
    within = within.withColumn("more", (F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("part")).cast("int")).drop("upto")
    out = first.unionByName(within)
    repeats = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(max_repeats), F.col("passes") + F.coalesce("more", F.lit(0)))).cast("int")
    out = out.withColumn("repeats", repeats).withColumn("taken", F.col("size") * F.col("repeats"))
    return out.drop("own_slice", "slice", "before", "passes", "part", "more", "cell")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and the one membership of each row of documents."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("size"), F.array("source").alias("memberships"), "text").withColumn("twin", F.xxhash64("text", F.col("memberships")[0])).drop("text")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Texts move once, to the ids; rows that repeat
    a doc_id are told apart by their text and source."""
    same = F.xxhash64("text", "source")
    taken = mix(sized(docs)).filter("repeats > 0")
    taken = materialise(taken.groupBy("doc_id", "twin").agg(F.max("repeats").alias("_repeats")).withColumnRenamed("doc_id", "_id"), "mix-taken")
    joined = docs.join(taken.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(taken["_id"]) & (same == taken["twin"]))
    times = F.explode(F.sequence(F.lit(1), taken["_repeats"]))
    copy = unused(docs, "_copy")
    return joined.select(*(docs[c] for c in docs.columns), times.alias(copy)).drop(copy)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "repeats")
