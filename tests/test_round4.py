import datetime
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.operators import graph_store, iteration, knowledge, resolve
from quillmap.plans import corpus, queries
from quillmap.sources import tables

from .conftest import SMALL
from .test_graph_store import frames, plain, tables_of, whole
from .test_sizes import planned, rows, some_tables


def test_values_are_those_of_pylist():
    at = datetime.datetime(2024, 1, 1)
    for made in (["a", None, "é"], [["a", None], None, [], ["b"]], [1, None, 3], [1, 2], [None, None], [1.5, None], [at, None], []):
        for kind in ({str: pa.string(), list: pa.list_(pa.string()), int: pa.int32(), float: pa.float64(), datetime.datetime: pa.timestamp("us")}.get(type(made[0]) if made else str, pa.string()),):
            whole = pa.array(made, kind)
            for part in (whole, whole.slice(1), whole.slice(0, max(len(made) - 1, 0))):
                assert iteration.values(part) == part.to_pylist()


def test_lines_are_shuffled_once_by_video(spark, monkeypatch, tmp_path):
    """Names are made canonical where the lines of a video lie; nothing is written, and nothing is shuffled by name."""
    at = some_tables(spark, tmp_path)
    kept, left = knowledge.deduplicate(corpus.crossing_mentions(spark, at), corpus.view(spark, at, "relationships"))
    kept = kept.select("video_id", "segment_id", "pos", "name", F.array_join("aliases", "|").alias("aliases"), "type", "definition", "importance")
    left = left.select("segment_id", "pos", "from_concept", "to_concept", "type", "evidence")
    for most in (300, iteration.ROWS):
        monkeypatch.setattr(iteration, "ROWS", most)
        for name, want, after in (("dedup_registry", kept, 0), ("dedup_relationships", left, 1)):
            got = queries.REGISTRY[name](spark, at)
            plan = planned(got)
            assert rows(got) == rows(want) and plan.count("MapInArrow") == 1 and "ExistingRDD" not in plan
            assert plan.split("MapInArrow")[0].count("Exchange") == after and plan.count("hashpartitioning(video_id") == 1 + after


def test_mentions_without_names_or_videos_stay(spark):
    m = spark.createDataFrame([(v, s, "s", p, n, a, "T", "d", "core", None) for v, s, p, n, a in ((None, 1, 1, "As", ["B"]), (None, 1, 2, "A", None), ("v", 1, 1, None, ["B"]), ("v", 1, 2, None, None), ("v", 1, 3, "b", None), ("v", None, 1, "C", [None, "c"]))],
                              "video_id string, seg_no int, segment_id string, pos int, name string, aliases array<string>, type string, definition string, importance string, timestamp_range struct<start:double,end:double>")
    r = spark.createDataFrame([(v, 1, "s", k, "As", "c", "is", "e") for k, v in enumerate(("v", None))], "video_id string, seg_no int, segment_id string, pos int, from_concept string, to_concept string, type string, evidence string")
    kept, left = knowledge.deduplicate(m, r)
    assert sorted(map(str, (tuple(x)[:6] for x in kept.select("video_id", "seg_no", "pos", "name", "aliases", "definition").collect()))) == sorted(
        map(str, [(None, 1, 1, "As", ["B"], "d"), (None, 1, 2, "A", None, "d"), ("v", 1, 1, None, ["B"], "d"), ("v", None, 1, "C", ["c"], "d")])
    )
    assert sorted((str(x.video_id), x.from_concept, x.to_concept) for x in left.collect()) == [("None", "As", "c"), ("v", "As", "C")]


@pytest.mark.parametrize("groups, several", [(16, 0.0), (2, 0.2), (3, 0.7)])
def test_pairs_of_lists_and_of_rows_are_all_pairs_apart(spark, monkeypatch, groups, several):
    for name, n in (("GROUPS", groups), ("CHUNK", 3), ("KEY_ROWS", 5), ("TASK_PAIRS", 20)):
        monkeypatch.setattr(resolve, name, n)
    r = random.Random(groups)
    keys = [sorted(r.sample("xyz", r.randint(2, 3) if r.random() < several else 1)) for _ in range(60)]
    component = [r.choice([0, 0, 0, 1, 1, 2, k]) for k in range(60)]
    leads = [[x for x in ks if r.random() < 0.05] for ks in keys]
    state = [(i, x, ks, ks[:at], component[i], leads[i]) for i, ks in enumerate(keys) for at, x in enumerate(ks)]
    asked = lambda i, j: {*leads[i]} & {*keys[j]} or {*leads[j]} & {*keys[i]}
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if {*keys[i]} & {*keys[j]} and component[i] != component[j] and not asked(i, j)]
    with iteration.Steps(spark) as steps:
        got = resolve.pairs_apart(spark.createDataFrame(state, "idx long, key string, keys array<string>, before array<string>, component long, leads array<string>"), steps).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_pairs_within_a_group_arent_looked_at(spark):
    """Two components, each a list: the join is of lists that differ in their group, and no rows are held against each other."""
    state = spark.range(4000).select(F.col("id").alias("idx"), F.lit("k").alias("key"), F.array(F.lit("k")).alias("keys"), F.expr("cast(array() AS array<string>)").alias("before"), (F.col("id") % 2).alias("component"), F.expr("cast(array() AS array<string>)").alias("leads"))
    rows = resolve.in_groups(state)
    assert rows.filter(f"`group` = {resolve.GROUPS} OR NOT plain").isEmpty() and {r.group for r in rows.select("group").distinct().collect()} == {1, 2}
    lists = resolve._pairs_of_lists(rows)
    assert "component_a" not in planned(lists) and lists.count() == 2000 * 2000


def test_lines_give_mentions_and_relationships(spark, tmp_path):
    at = some_tables(spark, tmp_path)
    lined = corpus.view(spark, at, "lined")
    for got, want in ((corpus.with_aliases(lined.drop("to_concept")), corpus.mentions(spark, at)), (corpus.relationships_of(lined), corpus.view(spark, at, "relationships"))):
        assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)


@pytest.mark.parametrize("lasting", [(), tuple(graph_store.TABLES)])
def test_rows_of_videos_that_a_batch_lacks_are_left_out(spark, tmp_path, lasting):
    r, store = random.Random(5), graph_store.GraphStore(spark, str(tmp_path / "g"), parts=3)
    videos = {v: tables_of(r, v) for v in "abcd"}
    store.write(frames(spark, videos["a"], videos["b"]), lasting)
    store.write(frames(spark, videos["b"], videos["c"], videos["d"] | {"videos": []}), lasting)
    nameless = {name: t.withColumn("video_id", F.lit(None).cast("string")) for name, t in frames(spark, videos["d"]).items() if name != "videos"}
    store.write({name: t.unionByName(nameless[name]) if name in nameless else t for name, t in frames(spark, videos["c"]).items()}, lasting)
    assert plain(store.read()) == whole(spark, {v: videos[v] for v in "abc"})


def test_rows_meet_the_videos_of_their_folder_and_are_not_shuffled(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        old = spark.range(900).select(F.concat(F.lit("v"), F.col("id") % 90).alias("video_id"), "id").withColumn("part", tables.part_of("video_id", 4))
        gone = spark.range(30).select(F.concat(F.lit("v"), "id").alias("video_id"))
        for most, shuffles in ((8, 0), (7, 2)):
            monkeypatch.setattr(tables, "BESIDE", most)
            left = tables.without(old, "video_id", gone, [0, 1, 2, 3], 4, 30)
            assert left.count() == 600 and planned(left).count("Exchange hashpartitioning") == shuffles
        assert tables.without(old, "video_id", gone.limit(0), [0], 4, 0) is old
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_was_shuffled_for_a_state_goes_once_it_is_written(spark):
    name, at = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: {f for _, _, found in os.walk(at) for f in found if f.startswith("shuffle_") and f.endswith(".data")}
    before, had = spark.conf.get(name), files()
    with iteration.Steps(spark) as steps:
        kept = steps.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
        until = time.time() + 10
        while files() - had and time.time() < until:
            time.sleep(0.1)
        assert not files() - had and spark.conf.get(name) == before and len(kept.collect()) == 7


def test_few_folders_are_written_without_a_sort(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(300).withColumn("part", (F.col("id") % 5).cast("int"))
    assert tables.replace_partitions(df, str(tmp_path / "t"), "part", [0, 1, 2, 3, 4, 5], shuffle=False) == [0, 1, 2, 3, 4, 5]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
