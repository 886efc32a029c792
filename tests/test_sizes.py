from pyspark.sql import functions as F

from quillmap.operators import graph, iteration, resolve
from quillmap.plans import corpus, queries

from .conftest import SMALL


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def some_tables(spark, at):
    """Lines without a part or an order, and orders of one line, beside the others."""
    for t, which in (("lineitem", "true"), ("orders", "o_orderkey % 5 <> 2"), ("part", "p_partkey % 9 <> 4")):
        spark.read.parquet(f"{SMALL}/{t}.parquet").filter(which).write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_relationships_come_of_one_window_of_the_lines(spark, tmp_path):
    at = some_tables(spark, tmp_path)
    got = corpus.view(spark, at, "relationships")
    want = spark.sql(corpus.VIEWS["relationships"], mentions=corpus.view(spark, at, "mentions"))
    assert rows(got) == rows(want) and got.schema.simpleString() == want.schema.simpleString() and got.count() > 100
    assert "hashpartitioning(seg_no" not in planned(got)


def test_mentions_of_many_lines_are_dealt_by_number(spark, tmp_path, monkeypatch):
    at = some_tables(spark, tmp_path)
    whole = {v: rows(corpus.view(spark, at, v)) for v in ("mentions", "relationships")}
    monkeypatch.setattr(iteration, "ROWS", 300)
    n = -(-spark.read.parquet(f"{at}/lineitem.parquet").count() // 300)
    for v in whole:
        df = corpus.view(spark, at, v)
        assert rows(df) == whole[v] and f", {n}), REPARTITION_BY_NUM" in planned(df)
    assert f", {n}), REPARTITION_BY_NUM" in planned(queries.REGISTRY["unique_concepts"](spark, at))


def test_appearances_are_shuffled_once_for_all_counts(spark, monkeypatch):
    monkeypatch.setattr(iteration, "ROWS", 300)
    m = spark.range(3000).select(*[F.concat(F.lit(p), F.pmod(F.xxhash64("id", F.lit(p)), F.lit(k))).alias(c) for p, k, c in (("n", 7, "name"), ("v", 40, "video_id"))]).withColumn("segment_id", F.concat("video_id", F.lit("s")))
    m = m.withColumns({"seg_no": F.lit(1), "pos": F.lit(1), "aliases": F.array("name"), "type": F.lit("t"), "definition": F.lit("d"), "importance": F.lit("core")})
    count = lambda seen: seen.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"))
    dealt, plain = count(resolve.concept_appearances(m, 3000)[1]), count(resolve.concept_appearances(m)[1])
    assert "REPARTITION_BY_NUM" in planned(dealt) and planned(dealt).count("Exchange") == 2
    assert rows(dealt) == rows(plain)


def test_edges_are_chosen_before_their_ends_are_looked_up(spark):
    said = [("a", "b", "x", f"e{v}{n}{p}", v, n, p) for v in ("v1", "v2") for n in (None, 1, 2) for p in (None, 4, 3)] + [("a", "c", "x", "e", "v1", 1, 1), ("b", "a", "x", "first", "v9", 2, 7), ("b", "a", "x", "later", "v9", 2, 8)]
    r = spark.createDataFrame(said, "from_concept string, to_concept string, type string, evidence string, video_id string, seg_no int, pos int")
    got = graph.concept_edges(r, spark.createDataFrame([("a",), ("b",)], "name string"))
    top = got._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("LeftSemi") < top.index("Aggregate") and top.count("max_by") == 1
    assert sorted(map(tuple, got.collect())) == [("a", "b", "X", "ev2NoneNone", "v2"), ("b", "a", "X", "first", "v9")]
