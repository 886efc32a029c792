"""Graph traversals as loops of joins: breadth-first depths, topological levels, components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .iteration import Steps, cut

#: Rounds after which what was gathered so far is written, so plans don't grow without end.
FLAT = 16
#: Edges that one task joins to components at most.
REST = 100_000


def reach(edges: DataFrame, target: str, max_depth: int = 10, with_target: bool = False) -> DataFrame:
    """edges: (src, dst). (name, depth) of what can be reached in 1 to max_depth steps; with_target adds the target at depth 0.

    Without it the target itself appears if it lies on a cycle. Each round joins the new nodes
    only, so work follows the edges seen, not the paths.
    """
    with Steps(edges.sparkSession) as steps:
        ways = steps.keep(edges.select("src", "dst").distinct())
        if with_target:
            first, depth = edges.sparkSession.createDataFrame([(target, 0)], "name string, depth int"), 0
        else:
            first, depth = ways.filter(F.col("src") == target).select(F.col("dst").alias("name"), F.lit(1).alias("depth")).distinct(), 1
        new, n = steps.keep_counted(first)
        seen = new
        while depth < max_depth and n:
            depth += 1
            new, n = steps.keep_counted(ways.join(new, ways.src == new.name).select(F.col("dst").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)))
            seen = seen.unionByName(new) if depth % FLAT else steps.keep(seen.unionByName(new))
        return cut(seen)


def prerequisites(edges: DataFrame, target: str, max_depth: int = 10, concepts: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """(name, depth), with definition and first location where concepts and locations are given. max_depth is from 1 to 20."""
    if not 1 <= max_depth <= 20:
        raise ValueError("max_depth must be from 1 to 20")
    out = reach(edges, target, max_depth)
    if concepts is not None:
        out = out.join(concepts.select("name", F.coalesce("definition", F.lit("")).alias("definition")), "name", "left")
    return out if locations is None else out.join(first_locations(locations), "name", "left")


def by_depth(found: DataFrame) -> DataFrame:
    """The nearest prerequisites first, ties by name."""
    return found.orderBy("depth", "name")


def depth_summary(found: DataFrame) -> DataFrame:
    """One row: how many prerequisites there are and their greatest depth, 0 without any."""
    return found.agg(F.count("*").alias("prerequisites"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def concept_locations(explained_in: DataFrame, segments: DataFrame, belongs_to: DataFrame, videos: DataFrame) -> DataFrame:
    """(name, segment_id, video_id, start, end) for whole paths from a concept to a video only."""
    path = explained_in.select(F.col("concept").alias("name"), "segment_id").distinct().join(segments.select("segment_id", "start", "end"), "segment_id").join(belongs_to, "segment_id")
    return path.join(videos.select("video_id"), "video_id").select("name", "segment_id", "video_id", "start", "end")


def first_locations(locations: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("segment_id", "video_id", "start", "end"), F.struct("start", "segment_id")).alias("at")
    return locations.groupBy("name").agg(first).select("name", "at.*")


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose both ends are among the names."""
    n = names.select("name").distinct()
    return edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi")


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, level): 0 without prerequisites, else one more than the highest prerequisite's; null on or behind a cycle.

    edges: src needs dst. Each round frees the nodes all of whose prerequisites are placed.
    """
    with Steps(edges.sparkSession) as steps:
        left = steps.keep(nodes.select("name").distinct())
        needs = steps.keep(induced(edges, left).select("src", "dst").distinct())
        placed, level = None, 0
        while True:
            waiting = needs.join(left.withColumnRenamed("name", "dst"), "dst", "left_semi").select(F.col("src").alias("name")).distinct().withColumn("waits", F.lit(True))
            state = steps.keep(left.join(waiting, "name", "left"))
            free, left = state.filter("waits is null").select("name", F.lit(level).alias("level")), state.filter("waits").select("name")
            placed = free if placed is None else placed.unionByName(free)
            n = state.agg(F.count("*").alias("n"), F.count("waits").alias("waiting")).first()
            if n["waiting"] in (0, n["n"]):
                return cut(placed.unionByName(left.withColumn("level", F.lit(None).cast("int"))))
            level += 1
            if level % FLAT == 0:
                placed = steps.keep(placed)


def topo_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, level, position): by level and name, what is on or behind a cycle last by name. Positions number the result, which is one learning path."""
    order = Window.orderBy(F.col("level").asc_nulls_last(), "name")
    return topo_levels(edges, nodes).withColumn("position", F.row_number().over(order))


def learning_path(edges: DataFrame, target: str, known: list[str] = (), max_depth: int = 10, concepts: DataFrame | None = None, locations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps in the order to learn them, and one header row (target, total_steps, total_seconds, skipped)."""
    spark: SparkSession = edges.sparkSession
    reached = reach(edges, target, max_depth, with_target=True)
    if concepts is not None:
        reached = reached.join(concepts.select("name"), "name", "left_semi")
    knows = spark.createDataFrame([(k,) for k in known], "name string")
    steps = topo_order(induced(edges, reached), reached.join(knows, "name", "left_anti"))
    if locations is not None:
        steps = steps.join(first_locations(locations), "name", "left").withColumn("seconds", F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)))
    else:
        steps = steps.withColumn("seconds", F.lit(0.0))
    skipped = knows.join(reached, "name", "left_semi").agg(F.array_sort(F.collect_set("name")).alias("skipped"))
    header = steps.agg(F.count("*").alias("total_steps"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds")).crossJoin(skipped).withColumn("target", F.lit(target))
    return steps, header


def connected(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any type with an order. (node, component), one row per node that has an edge to another: the smallest node connected to it.

    Randomised contraction: in each round every node goes to the one of itself and its neighbours
    that has the least hash, hashes being drawn anew, and edges are redrawn between what is left. That
    halves a chain and leaves at most 2/3 of the nodes of any graph, on average (the first round goes by
    the nodes themselves, which ends stars about their smallest node at once), so rounds grow with
    the logarithm of the nodes and all rounds together cost about as much as the first three. The
    ways of a node are then followed in one plan. Least hashes are partial aggregations and look-ups
    are joins that AQE can split, so a hub never meets in one task. What is left is counted as it is written;
    once it is REST edges at most, one task finishes it, as rounds over few edges cost their jobs only.
    No side of a join is broadcast: a round's sides are small one by one, but all of them would go through the driver.
    """
    with Steps(edges.sparkSession) as steps:
        left, n = steps.keep_counted(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rounds = []
        while n > REST:
            drawn = lambda c: F.struct((F.xxhash64(c, F.lit(len(rounds))) if rounds else F.lit(0).cast("long")).alias("h"), F.col(c).alias("to"))
            both = left.union(left.select("b", "a"))
            moves = steps.keep(both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", drawn("a"))["to"].alias("to")))
            left, n = steps.keep_counted(
                left.join(moves.toDF("a", "from").hint("merge"), "a").join(moves.toDF("b", "to").hint("merge"), "b").filter("from <> to")
                .select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
            )
            rounds.append(moves)
        if n:
            rounds.append(steps.keep(united(left)))
        if not rounds:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
        found = rounds[0]
        for moves in rounds[1:]:
            found = found.join(moves.toDF("to", "then").hint("merge"), "to", "left").select("node", F.coalesce("then", "to").alias("to"))
        if len(rounds) == 1 and n:
            return cut(found.toDF("node", "component"))
        found = steps.keep(found)
        names = found.groupBy("to").agg(F.min("node").alias("component"))
        return cut(found.join(names.hint("merge"), "to").select("node", "component"))


def united(edges: DataFrame) -> DataFrame:
    """(node, to), to being the smallest connected node, of at most REST edges, in one task."""

    def unite(frames):
        up = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"]):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": list(up), "to": [top(x) for x in up]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(unite, f"node {kind}, to {kind}")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges: (a, b); nodes: (id). (id, component): the smallest id that is connected."""
    found = connected(edges.select("a", "b"))
    return nodes.select("id").distinct().join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
