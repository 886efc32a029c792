"""Listing, paging and detail of the graph; each function is one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import induced


class NotFound(KeyError):
    """There is no such concept or video."""


def _page(skip: int, limit: int, most: int) -> None:
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must not be negative, limit from 1 to {most}")


def list_concepts(concepts: DataFrame, skip: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """By importance as text from the end (supporting, mentioned, core), then by name."""
    _page(skip, limit, most)
    return concepts.orderBy(F.col("importance").desc_nulls_first(), "name").offset(skip).limit(limit)


def graph_page(concepts: DataFrame, edges: DataFrame, skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    nodes = list_concepts(concepts, skip, limit, 500)
    return nodes, induced(edges, nodes)


def concept_defaults(concepts: DataFrame) -> DataFrame:
    """Nulls as they are told: no aliases, empty texts."""
    return concepts.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>"))} | {c: F.coalesce(c, F.lit("")) for c in ("type", "definition", "importance")})


def segment_defaults(segments: DataFrame) -> DataFrame:
    """Nulls as they are told: an empty title, times of 0."""
    return segments.withColumns({"title": F.coalesce("title", F.lit(""))} | {c: F.coalesce(c, F.lit(0.0)) for c in ("start", "end")})


def concept_relations(edges: DataFrame, name: str) -> DataFrame:
    """(other, type, evidence) of edges from and to the concept, without their direction."""
    out = edges.filter(F.col("src") == name).select(F.col("dst").alias("other"), "type", "evidence")
    return out.union(edges.filter(F.col("dst") == name).select("src", "type", "evidence")).distinct()


def concept_segments(name: str, explained_in: DataFrame, segments: DataFrame, videos: DataFrame) -> DataFrame:
    mine = explained_in.filter(F.col("concept") == name).select("segment_id").distinct()
    return segments.join(mine, "segment_id").join(videos.select("video_id", F.col("title").alias("video_title")), "video_id").orderBy("start", "segment_id")


def concept_detail(name: str, concepts: DataFrame, edges: DataFrame, explained_in: DataFrame, segments: DataFrame, videos: DataFrame) -> dict[str, DataFrame]:
    node = concepts.filter(F.col("name") == name)
    if node.isEmpty():
        raise NotFound(name)
    return {"concept": node, "relations": concept_relations(edges, name), "segments": concept_segments(name, explained_in, segments, videos)}


def list_videos(videos: DataFrame) -> DataFrame:
    return videos.withColumn("status", F.coalesce("status", F.lit("completed"))).orderBy("title", "video_id")


def video_segments(video_id: str, segments: DataFrame) -> DataFrame:
    out = segments.filter(F.col("video_id") == video_id).orderBy("start", "segment_id")
    if out.isEmpty():
        raise NotFound(video_id)
    return out


def segment_at(times: DataFrame, segments: DataFrame, slot: float = 60.0) -> DataFrame:
    """times: (video_id, t). The first segment with start <= t < end, one row per time that has one.

    Times and segments meet by video and by slots of `slot` seconds, so a time is compared with the
    segments about it only and a long video isn't one key.
    """
    at = lambda c: F.floor(F.col(c) / slot)
    s = segments.filter("start < end").select("video_id", "segment_id", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("slot"))
    hit = times.select("video_id", "t", at("t").alias("slot")).join(s, ["video_id", "slot"]).filter((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
    return hit.groupBy("video_id", "t").agg(F.min_by("segment_id", F.struct("start", "segment_id")).alias("segment_id"))


def timeline(segments: DataFrame) -> DataFrame:
    """Place and width of each segment as a percentage of its video's last end."""
    last = F.max_by("end", F.struct("start", "segment_id")).over(Window.partitionBy("video_id"))
    part = lambda c: F.when(F.col("last") > 0, c / F.col("last") * 100).otherwise(0.0)
    return segments.withColumn("last", last).select("video_id", "segment_id", part(F.col("start")).alias("left"), part(F.col("end") - F.col("start")).alias("width"))


def segment_concepts(segment_id: str, explained_in: DataFrame, concepts: DataFrame) -> DataFrame:
    return concepts.join(explained_in.filter(F.col("segment_id") == segment_id).select(F.col("concept").alias("name")), "name", "left_semi")


def merge_edges(loaded: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges loaded so far and more, each (src, type, dst) once, where both ends are loaded."""
    return induced(loaded.unionByName(more).dropDuplicates(["src", "type", "dst"]), nodes)


def status_summary(videos: DataFrame) -> DataFrame:
    return videos.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "failed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
