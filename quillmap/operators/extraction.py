"""Model responses, as tables, to typed mentions, relationships, examples and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses as R

#: The unit that holds relationships found across all segments of a video.
GLOBAL = "global"


def of_kind(responses: DataFrame, kind: str) -> DataFrame:
    return responses.filter(F.col("kind") == kind).select("video_id", "segment_id", "body")


def extract_mentions(responses: DataFrame, segments: DataFrame) -> DataFrame:
    """Concepts of every answered segment, with the segment's range."""
    s = segments.select("segment_id", "seg_no", F.struct("start", "end").alias("timestamp_range"))
    found = of_kind(responses, "concepts").select("video_id", "segment_id", F.posexplode(R.concepts(F.col("body"))).alias("pos", "c"))
    return found.join(s, "segment_id").select("video_id", "seg_no", "segment_id", "pos", "c.*", "timestamp_range")


def extract_relationships(responses: DataFrame, segments: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relationships of the segments that have concepts."""
    found = of_kind(responses, "relationships").join(mentions.select("segment_id").distinct(), "segment_id", "left_semi").select("video_id", "segment_id", F.posexplode(R.relationships(F.col("body"))).alias("pos", "r"))
    return found.join(segments.select("segment_id", "seg_no"), "segment_id").select("video_id", "seg_no", "segment_id", "pos", "r.*")


def global_relationships(responses: DataFrame, mentions: DataFrame) -> DataFrame:
    """One more unit for each video with at least two concept names."""
    several = mentions.groupBy("video_id").agg(F.countDistinct("name").alias("n")).filter("n >= 2").select("video_id")
    found = of_kind(responses, GLOBAL).join(several, "video_id", "left_semi").select("video_id", F.posexplode(R.relationships(F.col("body"))).alias("pos", "r"))
    return found.select("video_id", F.lit(2**31 - 1).alias("seg_no"), F.lit(GLOBAL).alias("segment_id"), "pos", "r.*")


def extract_metadata(responses: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments with their titles, examples, and key quotes."""
    m = of_kind(responses, "metadata").select("segment_id", R.metadata(F.col("body")).alias("m"))
    titled = segments.join(m.select("segment_id", F.col("m.title").alias("told")), "segment_id", "left").withColumn("title", F.coalesce("told", "title")).drop("told")
    return titled, m.select("segment_id", F.posexplode("m.examples").alias("pos", "x")).select("segment_id", "pos", "x.*"), m.select("segment_id", F.posexplode("m.key_quotes").alias("pos", "x")).select("segment_id", "pos", "x.*")


def prompts(template: str, segments: DataFrame, **values) -> DataFrame:
    """(segment_id, prompt): the template with {name} replaced by columns, given as name=column."""
    text = F.lit(template)
    for name, column in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return segments.select("segment_id", text.alias("prompt"))
