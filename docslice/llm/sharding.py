"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, to the least-loaded shard through a heap. The heap
runs on the driver, so its input must be bounded: a group larger than 1/2**14 of all bytes is scheduled alone (there
can be 2**14 of these at most); all other groups are first bundled by hash into 2**14 bundles. The rule is the same
at every size, and with fewer groups than bundles it is plain LPT but for groups that share a bundle.

Slots are dealt without a sort of a whole shard: an item's rows fall into cells of at most about 1/2**14 of all rows
(by a hash of the row itself, so that null or repeated ids and equal texts are parted as well), the driver lays the
cells of each shard end to end, and a row's slot is its cell's start plus its rank in the cell.

Defined cases: a null text has size 8 (no bytes) and forms its own group, apart from the empty text; its crc32 is
that of no bytes, 0. Repeated rows are kept and stay together. An empty table gives an empty result. Extra columns are
ignored; the input's own doc_id and text columns are the only ones read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.runtime import materialise, table

#: Bundles of small groups, and the fraction of all bytes above which a group is scheduled alone.
BUNDLES = 1 << 14


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each (size, key): largest first, to the least-loaded shard; ties by key, then by shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `bytes`."""
    spark = docs.sparkSession
    body = F.col(text)
    base = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(body.isNull(), F.lit(-1)).otherwise(F.xxhash64(body)).alias("group"),
            F.monotonically_increasing_id().alias("row"),  # holds once it is written
        ),
        "shard-base",
    )
    groups = materialise(base.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    whole = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    all_bytes, all_rows = whole[0] or 0, whole[1] or 0
    #: at most BUNDLES of these, by the bound
    alone = groups.filter(F.col("bytes") * BUNDLES > all_bytes).select(F.col("group"), F.lit(True).alias("alone"))
    alone = spark.createDataFrame(alone.collect() or [], "group long, alone boolean")

    def keyed(df: DataFrame) -> DataFrame:
        """item: the group itself if it is scheduled alone, else its bundle."""
        bundle = F.pmod(F.col("group"), F.lit(BUNDLES))
        return df.join(F.broadcast(alone), "group", "left").withColumn("item", F.when(F.col("alone"), F.struct(F.lit(1).alias("kind"), F.col("group").alias("key"))).otherwise(F.struct(F.lit(0).alias("kind"), bundle.alias("key")))).drop("alone")

    items = keyed(groups).groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    placed = lpt([(r["bytes"], tuple(r["item"])) for r in items], shards)
    # cells: parts of an item of about all_rows / BUNDLES rows
    parts = {tuple(r["item"]): max(1, -(-r["rows"] * BUNDLES // max(all_rows, 1)) if r["rows"] > 64 else 1) for r in items}
    plan = spark.createDataFrame([(k, i, placed[(k, i)], parts[(k, i)]) for k, i in placed], "kind int, key long, shard int, parts long")
    rows = keyed(base).withColumns({"kind": F.col("item.kind"), "key": F.col("item.key")}).join(F.broadcast(plan), ["kind", "key"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.col("parts"))).select("doc_id", "size", "text_crc32", "shard", "kind", "key", "part")
    cells = rows.groupBy("shard", "kind", "key", "part").agg(F.count("*").alias("n")).collect()  # at most 3 * BUNDLES
    start, at = [], [0] * shards
    for r in sorted(cells, key=tuple):
        start.append((r["kind"], r["key"], r["part"], at[r["shard"]]))
        at[r["shard"]] += r["n"]
    starts = spark.createDataFrame(start, "kind int, key long, part long, start long")
    rank = F.row_number().over(Window.partitionBy("kind", "key", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(starts), ["kind", "key", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
