import os
import random
import time

import duckdb
from pyspark.sql import functions as F

from quillmap.operators import graph_store, knowledge, resolve, segmentation, sentences, traverse
from quillmap.plans import oracles, queries
from quillmap.schemas import WORDS
from quillmap.sources import documents as sources

from .conftest import SMALL
from .test_operators import rows


def against_oracle(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}')")
    want = con.sql(oracles.oracle_sql()[name])
    got = queries.REGISTRY[name](spark, folder)
    return [tuple(r) for r in got.select(*want.columns).collect()], want.fetchall()


def test_many_videos_of_the_registry_make_no_groups(spark):
    m = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("video_id"), F.lit(0).alias("seg_no"), F.lit(0).alias("pos"), F.lit("a").alias("name"), F.array(F.lit("b")).alias("aliases"), F.lit("model").alias("type"), F.lit("d").alias("definition"))
    began = time.time()
    assert knowledge.registry(m).agg(F.max("entry"), F.count("*")).first() == (0, 200_000)
    assert time.time() - began < 60


def test_a_long_video_merges_in_linear_time(spark):
    """20,000 segments of one video, whose texts together are 20 MB."""
    one = spark.range(20_000).select(
        F.lit("s").alias("segment_id"), F.lit("v").alias("video_id"), (F.col("id") + 1).cast("int").alias("seg_no"), F.lit("t").alias("title"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 10).alias("end"),
        F.repeat(F.lit("x"), 1000).alias("transcript"), F.array(F.struct(F.lit("x").alias("text"), (F.col("id") * 10.0).alias("start"), F.lit(0.0).alias("end"), F.lit(1.0).alias("confidence"))).alias("sentences"),
    )
    began = time.time()
    got = segmentation.merge_short(one, 25.0).select("seg_no", "start", "end", F.size("sentences").alias("n"), F.length("transcript").alias("l"))
    sizes = got.agg(F.count("*"), F.sum("n"), F.sum("l")).first()
    assert time.time() - began < 40 and sizes[1] == 20_000 and sizes[2] == 20_000 * 1001 - sizes[0] and got.filter("end - start < 25").isEmpty()


def test_a_long_video_takes_boundaries_in_linear_time(spark):
    times = spark.range(30_000).select(F.lit("v").alias("video_id"), F.col("id").alias("sent_idx"), (F.col("id") * 10.0).alias("start"))
    low = times.select("video_id", F.col("sent_idx").alias("idx"), F.pmod(F.hash("sent_idx"), F.lit(997)).cast("double").alias("depth"))
    began = time.time()
    got = sorted(r.idx for r in segmentation.greedy_boundaries(low, times, 25.0).collect())
    assert time.time() - began < 40 and len(got) > 6000 and min(b - a for a, b in zip(got, got[1:])) >= 3


def plain_merge(times, min_s):
    """Joins the first short piece, again and again."""
    p = [(s, e, [k]) for k, (s, e) in enumerate(times)]
    while len(p) > 1 and (k := next((k for k, x in enumerate(p) if x[1] - x[0] < min_s), None)) is not None:
        back = k > 0 and (k == len(p) - 1 or not p[k - 1][1] - p[k - 1][0] > p[k + 1][1] - p[k + 1][0])
        a = k - 1 if back else k
        p[a : a + 2] = [(p[a][0], p[a + 1][1], p[a][2] + p[a + 1][2])]
    return [(x[2][0], x[2][-1]) for x in p]


def test_merging_agrees_with_a_loop_whatever_the_times():
    r = random.Random(3)
    for _ in range(500):
        times = [(r.randint(0, 40) * 1.0, r.randint(0, 80) * 1.0) for _ in range(r.randint(1, 9))]
        assert segmentation.short_joined(times, 15.0) == plain_merge(times, 15.0)


def test_alias_pairs_come_once_without_a_shuffle_of_pairs(spark):
    r = random.Random(5)
    rows = [(i, f"n {r.randint(0, 9)}", r.choice([None, [f"n-{r.randint(0, 9)}", f"a {r.randint(0, 4)}", None]])) for i in range(80)]
    got = resolve.alias_pairs(spark.createDataFrame(rows, "idx long, name string, aliases array<string>"))
    keys = [{x.replace("-", " ") for x in (n, *(a or [])) if x} for _, n, a in rows]
    assert sorted(map(tuple, got.collect())) == [(i, j) for i in range(80) for j in range(i + 1, 80) if keys[i] & keys[j]]
    top = got._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    assert not top[0].startswith("Aggregate")


def test_a_path_that_skips_nothing(spark, tmp_path):
    for t in os.listdir(SMALL):
        if t != "part.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    spark.read.parquet(f"{SMALL}/part.parquet").filter("p_partkey not in (0, 1, 3)").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got, want = against_oracle(spark, str(tmp_path), "learning_path_header")
    assert want[0][3] is None and got == want


def test_documents_lie_in_few_files(spark, tmp_path):
    at = str(tmp_path / "docs")
    body = F.concat(F.lit('{"video_id":"v'), "id", F.lit('","title":"t","source":"s","duration":1.5,"segments":[],"knowledge_units":[],"concepts":[]'), F.when(F.col("id") % 7 == 0, "").otherwise("}"))
    sources.write_documents(spark.range(3000).select(F.concat(F.lit("v"), "id").alias("video_id"), body.alias("body")), at, parts=4)
    sources.write_documents(spark.range(2).select(F.concat(F.lit("v"), F.col("id") + 1).alias("video_id"), F.lit("[").alias("body")), at, parts=4)
    good, bad = sources.read_documents(spark, at)
    assert good.count() == 3000 - 429 - 2 and {r.video_id for r in bad.collect()} == {f"v{k}" for k in range(0, 3000, 7)} | {"v1", "v2"}
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(at) for f in files) <= 16


def test_distinct_counts_copy_no_rows(spark):
    assert "Expand" not in queries.concept_counts(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_calls_are_judged_without_lists(spark):
    assert "collect_list" not in queries.call_outcomes(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_parsed_once_for_its_problems(spark, tmp_path):
    sources.write_documents(spark.createDataFrame([("v", "[")], "video_id string, body string"), str(tmp_path / "d"), parts=2)
    _, bad = sources.read_documents(spark, str(tmp_path / "d"))
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3


def test_resolution_asks_once_and_not_within_a_group_and_agrees_with_all_pairs(spark, monkeypatch):
    """By a verifier that isn't transitive; the questions that it answers are counted."""
    monkeypatch.setattr(resolve, "STARS", 1)
    r = random.Random(8)
    made = [(i, f"n {r.randint(0, 3)}", [f"n-{r.randint(0, 3)}"] if r.random() < 0.1 else None, "t", "d", "core") for i in range(48)]
    keys = [{x.replace("-", " ") for x in (n, *(a or []))} for _, n, a, *_ in made]
    pairs = [(i, j) for i in range(48) for j in range(i + 1, 48) if keys[i] & keys[j]]
    answer = lambda i, j: (i * 7 + j * 13) % 11 < 2
    up = list(range(48))
    for _ in up:
        for i, j in pairs:
            if answer(i, j):
                up[i] = up[j] = min(up[i], up[j])
    asked = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            asked.add(len(b))
            b["verdict"] = ["SAME" if answer(i, j) else "DIFFERENT" for i, j in zip(b["idx_a"], b["idx_b"])]
            yield b

    c = spark.createDataFrame(made, "idx long, name string, aliases array<string>, type string, definition string, importance string")
    got = resolve.resolve(c, spark.createDataFrame([], "idx long, embedding array<float>"), lambda q: q.mapInPandas(told, q.select("*", F.lit("").alias("verdict")).schema))
    assert sorted((x.idx, x.members) for x in got.collect()) == sorted((k, up.count(k)) for k in set(up))
    assert asked.value < len(pairs)


def test_components_broadcast_nothing(spark, tmp_path, monkeypatch):
    plans, keep = [], traverse.Steps.keep
    monkeypatch.setattr(traverse, "REST", 0)
    monkeypatch.setattr(traverse.Steps, "keep", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df))[1])
    store = graph_store.ComponentStore(spark, str(tmp_path / "labels"))
    edges = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for k in (0, 1):
        store.add(edges.filter(F.col("a") % 2 == k))
    assert store.labels.count() == 21 and store.labels.filter("component <> 0").isEmpty()
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_noise_joins_relationships_once(spark):
    m = spark.createDataFrame([("v", 1, 1, "Patreon", "d"), ("v", 1, 2, "b", "d"), ("v", 2, 1, "Patreon page", "d"), ("v", 2, 2, None, "sponsor")], "video_id string, seg_no int, pos int, name string, definition string")
    r = spark.createDataFrame([("v", 1, "b", "Patreon"), ("v", 1, "Patreon", "b"), ("v", 2, "b", "Patreon"), ("v", None, "Patreon", "b"), ("v", 1, None, "b")], "video_id string, seg_no int, from_concept string, to_concept string")
    kept, left = knowledge.filter_noise(m, r)
    assert [tuple(x)[1:4] for x in kept.orderBy("seg_no").collect()] == [(1, 2, "b"), (2, 2, None)]
    assert sorted(map(str, left.collect())) == sorted(map(str, r.collect()[2:]))
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_sentences_of_a_long_video_are_cut_without_windows(spark):
    """Of 25,000 words, more than a batch has; a missing text, time or confidence counts as before."""
    n = F.col("id")
    made = spark.range(25_000).select(F.lit("v").alias("video_id"), n.alias("pos"), F.when(n != 3, F.lit("w")).alias("text"), n.cast("double").alias("start"), F.when(n != 60, n + 0.5).alias("end"), F.when(n > 49, 0.25).alias("confidence"))
    more = made.filter("pos < 4").withColumns({"video_id": F.lit("u"), "text": F.concat("text", F.lit(".")), "start": F.col("start") * 9})
    out = sentences.group_sentences(made.unionByName(more))
    got = sorted(map(tuple, out.collect()))
    assert got[:4] == [("u", k, "" if k == 3 else "w.", 9.0 * k, k + 0.5, None) for k in range(4)]
    assert [x[1] for x in got[4:]] == list(range(500)) and got[4][2:] == (" ".join(["w"] * 49), 0.0, 49.5, None) and got[5][3:] == (50.0, 99.5, 0.25)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def _stream(spark, at, batches):
    from quillmap.streaming.ingest import ingest, read_sentences, stream_words

    for words in batches:
        spark.createDataFrame(words, WORDS).coalesce(1).write.mode("append").parquet(str(at / "in"))
        query = ingest(stream_words(spark, str(at / "in")), str(at / "table"), str(at / "marks"))
        query.awaitTermination()
    return query, rows(read_sentences(spark, str(at / "table")), "video_id", "sent_idx")


def test_a_stream_keeps_a_state_for_a_group_of_videos_and_not_for_each(spark, tmp_path, monkeypatch):
    from quillmap.streaming import ingest

    monkeypatch.setattr(ingest.stream_sentences, "__defaults__", (50, 1.0, 7))
    r = random.Random(5)
    words = [(f"v{v}", p, r.choice(["one", "two", "three."]), 0.5 * p, 0.5 * p + 0.3, 0.5) for v in range(300) for p in range(r.randint(1, 90))]
    batches = [[w for w in words if w[1] < 20 and w[0] < "v2"], [w for w in words if w[1] > 40], r.sample(words, len(words) // 2), words]
    query, got = _stream(spark, tmp_path, batches)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 7
    assert got == rows(sentences.group_sentences(spark.createDataFrame(words, WORDS)), "video_id", "sent_idx")


def test_streamed_words_may_lack_times_and_confidences(spark, tmp_path):
    words = [("v", 0, "a", 0.0, 0.1, None), ("v", 1, None, None, None, 0.5), ("v", 2, "b", float("nan"), 0.9, 1.0), ("v", 3, "c.", 1.0, 1.1, None), (None, 0, "d", 0.0, 0.1, 1.0)]
    _, got = _stream(spark, tmp_path, [words[:1], words[1:2] + words[4:], words[3:4] + [("v", None, "x", 0.0, 0.0, 0.0)], words[2:3]])
    want = rows(sentences.group_sentences(spark.createDataFrame(words, WORDS)), "video_id", "sent_idx")
    assert repr(got) == repr(want) and len(want) > 1


def test_a_stream_leaves_the_session_s_settings(spark, tmp_path):
    from quillmap.streaming.ingest import BYTES_CHECK

    before = spark.conf.get(BYTES_CHECK)
    _stream(spark, tmp_path, [[("v", 0, "a.", 0.0, 0.1, 1.0)]])
    assert spark.conf.get(BYTES_CHECK) == before


def test_thousandths_are_those_of_round(spark):
    from quillmap.functions.text import thousandths

    r = random.Random(6)
    made = [r.choice([1, -1]) * r.random() * 10 ** r.randint(-6, 18) for _ in range(20_000)] + [k / 1000 for k in range(-5000, 5000)] + [k / 10_000 + 0.00005 for k in range(20_000)]
    made += [0.0, -0.0, 0.0005, 2.0005, 1e300, 1.7e308, float("nan"), float("inf"), -float("inf"), None]
    got = spark.createDataFrame([(x,) for x in made], "x double").select("x", thousandths("x").alias("a"), F.round("x", 3).alias("b")).collect()
    assert [repr(g.a) for g in got] == [repr(g.b) for g in got]


def test_streamed_sentences_splits_texts_once(spark, monkeypatch):
    seen = []
    split = queries.split_texts
    monkeypatch.setattr(queries, "split_texts", lambda *a: seen.append(a) or split(*a))
    got, want = against_oracle(spark, SMALL, "streamed_sentences")
    assert len(seen) == 1 and sorted(got) == sorted(want)
