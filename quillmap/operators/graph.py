"""The property graph as node and edge tables, with keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import example_id
from .extraction import GLOBAL


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], set_cols: list[str], order: str | None = None) -> DataFrame:
    """Rows of existing with set_cols overwritten, nulls too, where incoming has the key, and incoming's new rows. Of incoming's repeated keys the last by `order` wins."""
    last = Window.partitionBy(*keys).orderBy(*([F.col(order).desc()] if order else keys))
    new = incoming.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select(*keys, *set_cols, F.lit(True).alias("_new"))
    new = new.select(*[F.col(c).alias(f"_{c}") for c in keys], *[F.col(c).alias(f"_{c}") for c in set_cols], "_new")
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    both = existing.join(new, on, "full_outer")
    value = lambda c: F.coalesce(c, f"_{c}") if c in keys else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in set_cols else F.col(c)
    return both.select(*[value(c).alias(c) for c in existing.columns])


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; a sound table has none."""
    return key_counts(table, *keys).filter("n > 1")


def key_counts(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n"))


def belongs_to(segments: DataFrame, videos: DataFrame) -> DataFrame:
    return segments.select("segment_id", "video_id").join(videos.select("video_id").distinct(), "video_id", "left_semi").distinct()


def explained_in(mentions: DataFrame, concepts: DataFrame, segments: DataFrame) -> DataFrame:
    """(concept, segment_id, video_id) where both ends exist; the global unit is no segment."""
    edges = mentions.filter(F.col("segment_id") != GLOBAL).select(F.col("name").alias("concept"), "segment_id", "video_id").distinct()
    return edges.join(concepts.select(F.col("name").alias("concept")).distinct(), "concept", "left_semi").join(segments.select("segment_id").distinct(), "segment_id", "left_semi").select("concept", "segment_id", "video_id")


def concept_edges(relationships: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, type, evidence, video_id): per video the first evidence, over videos the last, where both ends exist.

    That is one choice by (last video, first place, nulls being first), made before ends are looked up, so what is shuffled are edges and not all that names them.
    """
    r = relationships.select(F.col("from_concept").alias("src"), F.col("to_concept").alias("dst"), F.upper("type").alias("type"), "evidence", "video_id", "seg_no", "pos")
    early = [x for c in ("seg_no", "pos") for x in (F.col(c).isNull().alias(f"no_{c}"), (-F.col(c).cast("long")).alias(c))]
    last = F.max_by(F.struct("evidence", "video_id"), F.when(F.col("video_id").isNotNull(), F.struct("video_id", *early)))
    edges = r.groupBy("src", "dst", "type").agg(last.alias("last")).select("src", "dst", "type", "last.evidence", "last.video_id")
    names = concepts.select("name").distinct()
    return edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst", "type", "evidence", "video_id")


def example_nodes(examples: DataFrame) -> DataFrame:
    return examples.select(example_id(F.col("segment_id"), F.col("pos").cast("int") + 1).alias("example_id"), "segment_id", "description", "illustrates", "timestamp")


def illustrates(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    return nodes.select("example_id", F.col("illustrates").alias("concept")).join(concepts.select(F.col("name").alias("concept")).distinct(), "concept", "left_semi").select("example_id", "concept")


def build_graph(videos: DataFrame, segments: DataFrame, concepts: DataFrame, mentions: DataFrame, relationships: DataFrame, examples: DataFrame) -> dict[str, DataFrame]:
    """All node and edge tables, and a row of counts of what was tried and what has both ends."""
    nodes = example_nodes(examples)
    tables = {
        "videos": videos, "segments": segments, "concepts": concepts, "examples": nodes, "belongs_to": belongs_to(segments, videos), "explained_in": explained_in(mentions, concepts, segments),
        "concept_edges": concept_edges(relationships, concepts), "illustrates": illustrates(nodes, concepts),
    }
    tried = relationships.select("video_id", "from_concept", "to_concept", F.upper("type").alias("type")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(videos, "videos").crossJoin(count(segments, "segments")).crossJoin(count(concepts, "concepts")).crossJoin(count(tried, "relationships")).crossJoin(count(tables["concept_edges"], "relationships_made")).crossJoin(count(nodes, "examples"))
    return tables | {"stats": stats}
