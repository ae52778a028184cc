"""The full chunk model: identity, modality, parents and children, metadata without empty fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODALITIES = ("text", "image", "audio", "video", "table", "mixed")


def chunk_id(key: Column, index: Column) -> Column:
    return F.concat_ws("_", key.cast("string"), index.cast("string"))


def modelled(chunks: DataFrame, chunker: str, modality: str | Column = "text", parent: Column | None = None, metadata: dict[str, Column] | None = None, key: str = "doc_id") -> DataFrame:
    """id, content, modality, size, hash, parent_id, metadata (canonical JSON; null fields are left out, extra ones are
    added), with key and chunk_index."""
    kind = F.lit(modality) if isinstance(modality, str) else modality
    fields = {"chunker_used": F.lit(chunker), "source": F.col(key).cast("string"), **(metadata or {})}
    told = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))))
    return chunks.select(key, "chunk_index", chunk_id(F.col(key), F.col("chunk_index")).alias("id"), "content", kind.alias("modality"), F.length("content").cast("long").alias("size"), F.md5(F.encode("content", "UTF-8")).alias("hash"), (parent if parent is not None else F.lit(None).cast("string")).alias("parent_id"), told.alias("metadata"))


def with_children(model: DataFrame) -> DataFrame:
    """Adds children_ids (sorted by chunk_index) of chunks that others name as their parent. A parent's children are
    gathered in one row, as the model wants them; `children` gives them as rows."""
    ids = model.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"]).alias("children_ids"))
    return model.join(ids, "id", "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def children(model: DataFrame) -> DataFrame:
    """parent_id, place, id: children as rows, for parents of any number of them."""
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("chunk_index", "id")).cast("long") - 1
    return model.filter(F.col("parent_id").isNotNull()).select("parent_id", place.alias("place"), "id")


def of_modality(model: DataFrame, *modalities: str) -> DataFrame:
    return model.filter(F.col("modality").isin(*modalities))


def merged_metadata(metadata: Column, more: dict[str, Column]) -> Column:
    """JSON metadata with further fields (which win over equal names), names sorted, null fields left out."""
    own = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    names = F.array(*(F.lit(k) for k in more))
    kept = F.map_filter(own, lambda k, v: v.isNotNull() & ~F.array_contains(names, k))
    extra = F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v.cast("string"))))
    both = F.map_concat(kept, F.map_filter(extra, lambda k, v: v.isNotNull()))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))
