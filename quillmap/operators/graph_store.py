"""The property graph as tables on disk, built video by video, and components that follow new edges."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import PARTS, exists, folders_of, part_of, replace_partitions, replace_rows, rows_of
from . import graph
from .iteration import Steps
from .traverse import connected

#: What is written for a video, with the keys of each table.
TABLES = {"videos": ["video_id"], "segments": ["segment_id"], "concepts": ["video_id", "name"], "mentions": ["video_id", "seg_no", "pos"], "relationships": ["video_id", "seg_no", "pos"], "examples": ["segment_id", "pos"]}


class DuplicateKeys(ValueError):
    """A batch holds a key more than once, or one that another video has."""


@dataclass(frozen=True)
class GraphStore:
    """Tables under path, each row of which a video owns.

    Nodes and edges are what reading them makes of these: a concept of several videos is one node with the
    properties of the last video that has it, and an edge stands if both of its ends do. So a video can be
    written again, or taken out, without looking at the others.
    """

    spark: SparkSession
    path: str
    parts: int = PARTS

    def write(self, batch: dict[str, DataFrame], lasting: tuple[str, ...] = ()) -> dict[str, list[int]]:
        """Puts in the tables of some videos, in place of all that these had; the folders written, by table.

        batch has the tables of TABLES, each with video_id; those of its videos table are rebuilt, and rows of others left out. It is made
        once, and keys are checked, before anything is written; tables named in lasting come of files that stay as they are, and are read twice
        instead. A batch without videos writes nothing; one that is repeated writes the same again.
        """
        with Steps(self.spark) as steps:
            owners = steps.keep(batch["videos"].select("video_id").distinct())
            touched = folders_of(owners, "video_id", self.parts)
            if not touched:
                return {name: [] for name in TABLES}
            made = {name: batch[name] if name in lasting else steps.keep(batch[name]) for name in TABLES}
            strangers = self.check(made, owners, steps)
            if strangers is not None:
                made = {name: t.filter("video_id IS NOT NULL").join(strangers, "video_id", "left_anti") for name, t in made.items()}
            known = owners.join(self.table("videos").select("video_id"), "video_id", "left_semi") if self._has("videos") else owners.limit(0)
            gone, n = steps.keep_counted(known)
            return {name: replace_rows(made[name], f"{self.path}/{name}", "video_id", gone, touched, self.parts, n) for name in TABLES}

    def remove(self, videos: DataFrame) -> None:
        """Takes out all that the videos own. videos: (video_id)."""
        touched = folders_of(videos, "video_id", self.parts)
        for name in TABLES:
            if self._has(name):
                replace_rows(self.table(name).limit(0), f"{self.path}/{name}", "video_id", videos, touched, self.parts)

    def check(self, batch: dict[str, DataFrame], owners: DataFrame, steps: Steps) -> DataFrame | None:
        """Raises where a key is there twice; the videos that tables name and owners doesn't, or None. All checks are one query, of keys alone; a sound batch has no row in it.

        Keys are dealt by video, where they meet owners, so that rows themselves needn't.
        """
        mine = owners.withColumn("mine", F.lit(True))
        told = lambda df, name, keys: df.select(F.lit(name).alias("table"), F.concat_ws(", ", *keys).alias("key"), "video_id", "mine")
        found = []
        for name, keys in TABLES.items():
            rows = batch[name].select(*dict.fromkeys(["video_id", *keys]))
            if "video_id" in keys:
                found.append(told(graph.key_counts(rows.repartition("video_id"), *keys).join(mine, "video_id", "left").filter("n > 1 OR mine IS NULL"), name, keys))
            else:
                held = rows.join(mine, "video_id", "left")
                twice = graph.duplicate_keys(held.filter("mine"), *keys).withColumns({"video_id": F.lit(None).cast("string"), "mine": F.lit(True)})
                found += [told(held.filter("mine IS NULL"), name, keys), told(twice, name, keys)]
        if self._has("segments"):
            others = self.table("segments").join(owners, "video_id", "left_anti").select("segment_id")
            held = batch["segments"].select("segment_id", "video_id").join(mine, "video_id").join(others, "segment_id", "left_semi")
            found.append(told(held, "segments of other videos", ["segment_id"]))
        found, n = steps.keep_counted(functools.reduce(DataFrame.unionByName, found))
        if n and (rows := found.filter("mine").limit(30).collect()):
            raise DuplicateKeys("; ".join(f"{r['table']}: {r['key']}" for r in rows))
        return found.filter("video_id IS NOT NULL").select("video_id").distinct() if n else None

    def _has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("part")

    def concepts(self) -> DataFrame:
        """One node for each name, with the properties that the last of its videos gave it."""
        c = self.table("concepts")
        return c.groupBy("name").agg(F.max_by(F.struct(*[x for x in c.columns if x != "name"]), "video_id").alias("c")).select("name", "c.*")

    def read(self) -> dict[str, DataFrame]:
        """Node and edge tables and counts, as build_graph() gives them."""
        t = {name: self.table(name) for name in TABLES}
        return graph.build_graph(t["videos"], t["segments"], self.concepts(), t["mentions"], t["relationships"], t["examples"].drop("video_id"))


@dataclass(frozen=True)
class ComponentStore:
    """Components of a growing graph, as rows (id, component) on disk in folders by the component's hash."""

    spark: SparkSession
    path: str
    kind: str = "bigint"

    @property
    def labels(self) -> DataFrame:
        return rows_of(self.spark, self.path, f"id {self.kind}, component {self.kind}, part int").drop("part")

    def add(self, edges: DataFrame) -> list[int]:
        """Follows new edges (a, b); the folders that were written.

        Both ends become the components that they lie in, a new node being its own. Only edges between
        different components matter, and only those components are contracted and only their rows written
        again. A component's name is its smallest node, so it stays that whatever the order in which edges come.
        """
        ends = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
        known = self.labels
        with Steps(self.spark) as steps:
            ids = steps.keep(ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().join(known.hint("merge"), "id", "left").withColumn("new", F.col("component").isNull()).withColumn("component", F.coalesce("component", "id")))
            of = lambda c: ids.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of")).hint("merge")
            between = steps.keep(ends.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).filter("a <> b").distinct())
            moved = steps.keep(connected(between).select(F.col("node").alias("component"), F.col("component").alias("to")))
            fresh = ids.filter("new").select("id", "component").join(moved.hint("merge"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            changed = moved.filter("component <> to")
            folders = moved.select("component").union(moved.select("to")).union(fresh.select("component")).select(part_of("component").alias("part")).distinct()
            touched = [r[0] for r in folders.collect()]  # PARTS at most
            if not touched:
                return []
            old = rows_of(self.spark, self.path, f"id {self.kind}, component {self.kind}, part int").filter(F.col("part").isin(touched)).drop("part")
            kept = old.join(changed.hint("merge"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            rows = kept.unionByName(fresh).withColumn("part", part_of("component"))
            return replace_partitions(rows, self.path, "part", touched)
