import random

import pytest
from pyspark.sql import functions as F

from quillmap.conf import EngineConf
from quillmap.operators import extraction, graph, knowledge, read_api, resolve, search, segmentation, sentences, traverse
from quillmap.schemas import MENTIONS, RELATIONSHIPS, RESULT, SENTENCES, WORDS
from quillmap.sources import documents as sources


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_conf():
    assert EngineConf.from_env({"MAX_WORDS": "7", "PAUSE_SECONDS": "2.5"}) == EngineConf(max_words=7, pause_seconds=2.5)


def model_sentences(words, most=5, pause=1.0):
    out, now = [], []
    for k, w in enumerate(words):
        now.append(w)
        if w[2][-1:] in ".?!" or len(now) == most or (k + 1 < len(words) and words[k + 1][3] - w[4] > pause):
            out.append(now)
            now = []
    return [" ".join(w[2] for w in s) for s in out + ([now] if now else [])]


def test_sentences_agree_with_a_loop(spark):
    r = random.Random(1)
    made, want = [], {}
    for v in "abc":
        t, mine = 0.0, []
        for k in range(80):
            t = round(t + r.choice([0.1, 0.2, 1.5]) * r.random() * 2, 2)
            mine.append((v, k, "w" + r.choice(["", "", "", ".", "?"]), t, round(t + 0.1, 2), 0.5))
        made += mine
        want[v] = model_sentences(mine)
    got = sentences.group_sentences(spark.createDataFrame(made, WORDS), max_words=5)
    assert {v: [x[2] for x in rows(got.filter(F.col("video_id") == v), "sent_idx")] for v in want} == want


def curve_of(spark, values):
    return spark.createDataFrame([("v", k, float(x), float(x)) for k, x in enumerate(values)], "video_id string, idx long, sim double, smoothed double")


def sentences_of(spark, n, seconds):
    return spark.createDataFrame([("v", k, f"s{k}.", k * seconds, (k + 1) * seconds, 0.9) for k in range(n)], SENTENCES)


def test_similarity_and_smoothing(spark):
    vectors = spark.createDataFrame([("v", k, x) for k, x in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])], "video_id string, sent_idx long, embedding array<float>")
    assert [r[2] for r in rows(segmentation.consecutive_similarity(vectors), "idx")] == [0.0, 0.0]
    c = curve_of(spark, [1, 0, 1, 0, 1])
    assert [round(r[0], 6) for r in c.select(segmentation.smooth("sim", 3)).collect()] == [0.666667, 0.666667, 0.333333, 0.666667, 0.666667]
    assert [r[0] for r in c.select(segmentation.smooth("sim", 1)).collect()] == [1, 0, 1, 0, 1]


def test_boundaries(spark):
    found = rows(segmentation.find_boundaries(curve_of(spark, [0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9]), sentences_of(spark, 8, 60.0), 30, 6000))
    assert found == [("v", 3)]
    assert rows(segmentation.find_boundaries(curve_of(spark, [0.9, 0.1]), sentences_of(spark, 3, 60.0), 30, 60)) == []
    assert len(rows(segmentation.find_boundaries(curve_of(spark, [0.9, 0.1, 0.9, 0.1, 0.9]), sentences_of(spark, 6, 5.0), 30, 6000))) <= 1


def test_long_segments_are_halved_once(spark):
    none = spark.createDataFrame([], "video_id string, idx long")
    assert rows(segmentation.split_long(none, sentences_of(spark, 8, 60.0), 200.0)) == [("v", 3)]


def segments_of(spark, spans):
    made = [(f"v_seg{k:03d}", "v", k, f"Segment {k}", float(a), float(b), f"t{k}", []) for k, (a, b) in enumerate(spans, 1)]
    from quillmap.schemas import SEGMENTS

    return spark.createDataFrame(made, SEGMENTS)


@pytest.mark.parametrize("spans, want", [([(0, 60), (60, 120), (120, 130)], [(0, 60), (60, 130)]), ([(0, 5), (5, 65), (65, 125)], [(0, 65), (65, 125)]), ([(0, 5)], [(0, 5)]), ([(0, 90), (90, 95), (95, 135)], [(0, 90), (90, 135)])])
def test_short_segments_merge(spark, spans, want):
    got = rows(segmentation.merge_short(segments_of(spark, spans)).select("segment_id", "start", "end"), "segment_id")
    assert got == [(f"v_seg{k:03d}", float(a), float(b)) for k, (a, b) in enumerate(want, 1)]


def merge_by_restarting(spans, min_s):
    spans = list(spans)
    while len(spans) > 1 and (short := [i for i, (a, b) in enumerate(spans) if b - a < min_s]):
        i = short[0]
        length = lambda k: spans[k][1] - spans[k][0]
        first = i - 1 if i == len(spans) - 1 else 0 if i == 0 else i - 1 if length(i - 1) <= length(i + 1) else i
        spans[first : first + 2] = [(spans[first][0], spans[first + 1][1])]
    return spans


@pytest.mark.parametrize("ordered", [True, False])
def test_short_segments_merge_as_if_restarted(spark, ordered):
    """Also where a video's times run backwards."""
    from quillmap.schemas import SEGMENTS

    r, made, want = random.Random(3), [], {}
    for v in range(150):
        at, spans = 0.0, []
        for _ in range(r.randint(1, 14)):
            at = at + r.randint(0, 30) if ordered else r.randint(0, 300)
            spans.append((float(at), float(at + r.choice([1, 5, 20, 29, 30, 31, 60]))))
            at = spans[-1][1]
        made += [(f"v{v}_seg{k:03d}", f"v{v}", k, f"T{k}", a, b, f"t{k}", [(f"x{k}", a, b, 1.0)]) for k, (a, b) in enumerate(spans, 1)]
        want[f"v{v}"] = merge_by_restarting(spans, 30)
    got = {}
    for x in sorted(segmentation.merge_short(spark.createDataFrame(made, SEGMENTS).repartition(4)).collect(), key=lambda x: (x.video_id, x.seg_no)):
        got.setdefault(x.video_id, []).append((x.start, x.end))
        assert x.segment_id == f"{x.video_id}_seg{len(got[x.video_id]):03d}" and x.transcript.split() == ["t" + s.text[1:] for s in x.sentences] and x.title[1:] == x.transcript.split()[0][1:]
    assert got == want


def test_one_sentence_is_one_segment(spark):
    vectors = spark.createDataFrame([("v", 0, [1.0])], "video_id string, sent_idx long, embedding array<float>")
    assert rows(segmentation.segment(sentences_of(spark, 1, 60.0), vectors).select("segment_id", "title")) == [("v_seg001", "Full transcript")]


def mentions_of(spark, *units, video="v"):
    made = [(video, u, f"{video}_seg{u:03d}", p, n, a, "definition", d, i, None) for u, unit in enumerate(units) for p, (n, a, d, i) in enumerate(unit)]
    return spark.createDataFrame(made, MENTIONS)


def relations_of(spark, *triples):
    return spark.createDataFrame([("v", 0, "v_seg000", k, a, b, t, f"e{k}") for k, (a, b, t) in enumerate(triples)], RELATIONSHIPS)


def test_dedup_by_case_plural_hyphen_and_alias(spark):
    m = mentions_of(spark, [("Neural Network", ["NN"], "short", "mentioned")], [("neural networks", [], "a longer one", "core"), ("NN", [], "", "core")], [("Neural-Network", ["nets"], "", "core")])
    kept, _ = knowledge.deduplicate(m, relations_of(spark))
    got = rows(kept.select("seg_no", "pos", "name", "aliases", "definition", "importance"), "seg_no")
    assert [x[:3] for x in got] == [(0, 0, "Neural Network"), (1, 0, "Neural Network"), (2, 0, "Neural Network")]
    assert got[0][3:] == (["NN", "Neural-Network", "nets", "neural networks"], "a longer one", "mentioned")


def test_relationships_are_canonical_and_once(spark):
    m = mentions_of(spark, [("Neuron", [], "", "core"), ("Networks", [], "", "core")])
    _, left = knowledge.deduplicate(m, relations_of(spark, ("neurons", "network", "depends_on"), ("Neuron", "Networks", "depends_on"), ("Networks", "Net", "is_part_of")))
    assert rows(left.select("from_concept", "to_concept", "type", "evidence"), "pos") == [("Neuron", "Networks", "depends_on", "e0"), ("Net", "Networks", "is_part_of", "e2")]


def test_noise(spark):
    m = mentions_of(spark, [("Patreon page", [], "", "core"), ("Loss", [], "", "core")])
    kept, left = knowledge.filter_noise(m, relations_of(spark, ("Loss", "Patreon page", "x"), ("Loss", "Loss", "x")))
    assert [r[0] for r in rows(kept.select("name"))] == ["Loss"] and [r[0] for r in rows(left.select("evidence"))] == ["e1"]


def test_unique_concepts_in_order(spark):
    m = mentions_of(spark, [("B", ["y"], "d", "mentioned"), ("A", [], "", "supporting")], [("B", ["x"], "longer", "supporting"), ("C", [], "", "core")])
    got = rows(knowledge.ranked(knowledge.unique_concepts(m)).select("name", "aliases", "definition", "importance"))
    assert got == [("C", [], "", "core"), ("A", [], "", "supporting"), ("B", ["x", "y"], "longer", "supporting")]


def test_extraction(spark):
    segments = segments_of(spark, [(0, 60), (60, 90)])
    answers = spark.createDataFrame([("v", "v_seg001", "concepts", '```json\n[{"name":"a"},{"name":"b"}]\n```'), ("v", "v_seg001", "relationships", '[{"from_concept":"a","to_concept":"b"}]'), ("v", "v_seg002", "relationships", '[{"from_concept":"a","to_concept":"b"}]'), ("v", "v_seg001", "metadata", '{"title":"T"}'), ("v", "v", "global", '[{"from_concept":"b","to_concept":"a","type":"extends"}]')], "video_id string, segment_id string, kind string, body string")
    m = extraction.extract_mentions(answers, segments)
    assert rows(m.select("segment_id", "pos", "name", "timestamp_range.end"), "pos") == [("v_seg001", 0, "a", 60.0), ("v_seg001", 1, "b", 60.0)]
    assert rows(extraction.extract_relationships(answers, segments, m).select("segment_id", "type")) == [("v_seg001", "depends_on")]
    assert rows(extraction.global_relationships(answers, m).select("segment_id", "from_concept", "type")) == [("global", "b", "extends")]
    assert rows(extraction.extract_metadata(answers, segments)[0].select("title"), "seg_no") == [("T",), ("Segment 2",)]
    assert rows(extraction.prompts("x {t}", segments, t=F.col("transcript")).select("prompt"), "prompt") == [("x t1",), ("x t2",)]


def test_graph(spark):
    videos = spark.createDataFrame([("v", "T")], "video_id string, title string")
    concepts = spark.createDataFrame([("A",), ("B",)], "name string")
    m = mentions_of(spark, [("A", [], "", "core"), ("B", [], "", "core"), ("Gone", [], "", "core")])
    segments = m.select("segment_id", "video_id").distinct()
    examples = spark.createDataFrame([("v_seg000", 0, "d", "A", None), ("v_seg000", 1, "d2", "Gone", None)], "segment_id string, pos int, description string, illustrates string, timestamp double")
    made = graph.build_graph(videos, segments, concepts, m, relations_of(spark, ("A", "B", "applies_to"), ("A", "B", "applies_to"), ("A", "Gone", "x")), examples)
    assert rows(made["concept_edges"]) == [("A", "B", "APPLIES_TO", "e0", "v")]
    assert rows(made["explained_in"], "concept") == [("A", "v_seg000", "v"), ("B", "v_seg000", "v")]
    assert rows(made["illustrates"]) == [("v_seg000_ex01", "A")]
    assert made["stats"].first().asDict() == {"videos": 1, "segments": 1, "concepts": 2, "relationships": 2, "relationships_made": 1, "examples": 2}
    assert graph.duplicate_keys(made["concepts"], "name").isEmpty()


def test_upsert_overwrites_with_null_and_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, "s"), ("b", 2, "t")], "k string, v int, keep string")
    new = spark.createDataFrame([("b", None, 1), ("c", 3, 1), ("c", 4, 2)], "k string, v int, o int")
    want = [("a", 1, "s"), ("b", None, "t"), ("c", 4, None)]
    once = graph.upsert(old, new, ["k"], ["v"], order="o")
    assert rows(once, "k") == want and rows(graph.upsert(once, new, ["k"], ["v"], order="o"), "k") == want


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_prerequisites(spark):
    e = edges_of(spark, ("NN", "Calc"), ("NN", "LA"), ("Calc", "LA"), ("LA", "Math"), ("Math", "NN"))
    assert rows(traverse.prerequisites(e, "NN"), "depth", "name") == [("Calc", 1), ("LA", 1), ("Math", 2), ("NN", 3)]
    assert rows(traverse.prerequisites(e, "NN", 1), "name") == [("Calc", 1), ("LA", 1)]
    assert rows(traverse.prerequisites(e, "none")) == []
    with pytest.raises(ValueError):
        traverse.prerequisites(e, "NN", 21)


def test_learning_path(spark):
    e = edges_of(spark, ("CNN", "NN"), ("NN", "LA"), ("CNN", "LA"), ("X", "CNN"))
    steps, header = traverse.learning_path(e, "CNN")
    assert [r[0] for r in rows(steps.select("name"), steps.position)] == ["LA", "NN", "CNN"]
    steps, header = traverse.learning_path(e, "CNN", ["LA", "other"])
    assert [r[0] for r in rows(steps.select("name"), steps.position)] == ["NN", "CNN"] and header.first()["skipped"] == ["LA"]


def test_cycles_come_last(spark):
    e = edges_of(spark, ("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("s", "s"))
    got = rows(traverse.topo_levels(e, spark.createDataFrame([(x,) for x in "abcdes"], "name string")), "name")
    assert got == [("a", None), ("b", None), ("c", None), ("d", 1), ("e", 0), ("s", None)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)], "a long, b long")
    assert rows(traverse.components(e, spark.range(1, 8)), "id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_long_chain_has_one_component(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert traverse.components(e, spark.range(61)).filter("component <> 0").isEmpty()


def test_resolution(spark):
    c = spark.createDataFrame([(0, "AI", ["A.I."], "t", "d", "core"), (1, "Artificial Intelligence", [], "t", "longer", "mentioned"), (2, "ML", [], "t", "", "core"), (3, "A.I.", [], "t", "", "core")], "idx long, name string, aliases array<string>, type string, definition string, importance string")
    v = spark.createDataFrame([(0, [1.0, 0.1]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "idx long, embedding array<float>")
    assert rows(resolve.candidate_pairs(c, v), "idx_a", "idx_b") == [(0, 1), (0, 3)]
    assert rows(resolve.similar_pairs(v, blocks=3).select("idx_a", "idx_b")) == [(0, 1)]
    merged = resolve.resolve(c, v, lambda p: p.withColumn("verdict", F.lit("SAME")))
    assert rows(merged.select("name", "aliases", "definition", "importance"), "name") == [("AI", ["A.I.", "Artificial Intelligence"], "longer", "core"), ("ML", [], "", "core")]
    none = resolve.apply_merges(c, spark.createDataFrame([(0, 1, "DIFFERENT", "")], "idx_a long, idx_b long, verdict string, reason string"))
    assert none.count() == 4


def test_verdicts_of_no_pair_are_dropped(spark):
    b = resolve.batched(spark.createDataFrame([(0, k) for k in range(1, 13)], "idx_a long, idx_b long"))
    answers = spark.createDataFrame([(1, 1, "SAME", ""), (1, 7, "SAME", "")], "batch_no long, pair_index long, verdict string, reason string")
    assert rows(resolve.with_verdicts(b, answers).select("idx_b")) == [(12,)]


def test_linking_needs_two_videos(spark):
    m = mentions_of(spark, [("AI", [], "", "core")]).union(mentions_of(spark, [("AI", [], "", "core"), ("ML", [], "", "core")], video="w"))
    first, seen = resolve.concept_appearances(m)
    merged = first.withColumn("aliases", F.array().cast("array<string>"))
    edges, counts = resolve.link_across(merged, seen, 2)
    assert edges.count() == 3 and counts.first()["across_videos"] == 1
    assert resolve.link_across(merged, seen, 1)[0].isEmpty()


def test_search(spark):
    vec = spark.createDataFrame([("s1", "v", "x" * 600, [1.0, 0.0]), ("s2", "w", "d", [0.0, 1.0]), ("s3", "w", "d", [-1.0, 0.0])], "segment_id string, video_id string, document string, embedding array<float>")
    g = {
        "explained_in": spark.createDataFrame([("AI", "s1", "v"), ("ML", "s1", "v")], "concept string, segment_id string, video_id string"),
        "concept_edges": spark.createDataFrame([("AI", "Math", "DEPENDS_ON"), ("ML", "Math", "DEPENDS_ON"), ("ML", "DL", "EXTENDS")], "src string, dst string, type string"),
        "illustrates": spark.createDataFrame([("e", "AI")], "example_id string, concept string"), "examples": spark.createDataFrame([("e", "Example 1")], "example_id string, description string"),
    }
    got = search.search(vec, [1.0, 0.0], g).collect()
    assert [r.segment_id for r in got] == ["s1", "s2", "s3"] and got[2].score == 0.0 and got[0].excerpt == "x" * 500 + "..."
    assert (got[0].concepts, got[0].prerequisites, got[0].related, got[0].examples, got[1].concepts) == (["AI", "ML"], ["Math"], ["DL"], ["Example 1"], [])
    assert [r.segment_id for r in search.search(vec, [1.0, 0.0], g, "w", 1).collect()] == ["s2"]


def test_index_keeps_the_last_of_names_that_agree(spark):
    c = spark.createDataFrame([("Node", ["n"], "a"), ("node", [], "b")], "name string, aliases array<string>, definition string")
    empty = spark.createDataFrame([], "id string, document string, aliases string")
    assert rows(search.index_concepts(empty, c, c.select("name"))) == [("concept_node", "node: b", "[]")]
    assert rows(search.index_concepts(empty, c.limit(0), c.select("name"))) == []


def test_reading(spark):
    c = spark.createDataFrame([("a", "core"), ("b", "supporting"), ("c", "mentioned")], "name string, importance string")
    assert [r[0] for r in rows(read_api.list_concepts(c))] == ["b", "c", "a"] and [r[0] for r in rows(read_api.list_concepts(c, 1, 1))] == ["c"]
    with pytest.raises(ValueError):
        read_api.list_concepts(c, 0, 201)
    e = spark.createDataFrame([("a", "b", "T", ""), ("a", "z", "T", "")], "src string, dst string, type string, evidence string")
    assert read_api.graph_page(c, e)[1].count() == 1 and rows(read_api.concept_relations(e, "b")) == [("a", "T", "")]
    with pytest.raises(read_api.NotFound):
        read_api.video_segments("none", segments_of(spark, [(0, 1)]))
    times = spark.createDataFrame([("v", 0.0), ("v", 10.0), ("v", 99.0)], "video_id string, t double")
    assert rows(read_api.segment_at(times, segments_of(spark, [(0, 10), (10, 20)])), "t") == [("v", 0.0, "v_seg001"), ("v", 10.0, "v_seg002")]
    assert [r[2:] for r in rows(read_api.timeline(segments_of(spark, [(0, 5), (5, 20)])), "segment_id")] == [(0.0, 25.0), (25.0, 75.0)]


def test_documents_round_trip(spark, tmp_path):
    one = [("v", "T", "src", 9.0, [], [("s", "S", (0.0, 1.0), [("n", ["a"], "t", "d", "core", None)], [("a", "b", "t", "e")], [("d", "n", None)], [("q", 1.0, "r")])], [])]
    df = spark.createDataFrame(one, RESULT)
    sources.write_results(df, str(tmp_path / "out"))
    assert sources.read_results(spark, str(tmp_path / "out")).collect() == df.collect()
    assert sources.read_results(spark, str(tmp_path / "none")).isEmpty()


def test_source_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# no\n\n  a \nb\n")
    assert rows(sources.read_source_list(spark, str(tmp_path / "list.txt"))) == [("a",), ("b",)]
    part = lambda *x: spark.createDataFrame(list(enumerate(x)), "ordinal int, source string")
    assert [r[2] for r in rows(sources.gather_sources(part("b", "a"), part("a"), most=2))] == ["b", "a"]


def stream_in(spark, at, batches):
    """Sentences after each batch of words arrived."""
    from quillmap.streaming.ingest import ingest, read_sentences, stream_words

    seen = []
    for words in batches:
        spark.createDataFrame(words, WORDS).coalesce(1).write.mode("append").parquet(str(at / "in"))
        ingest(stream_words(spark, str(at / "in")), str(at / "table"), str(at / "marks")).awaitTermination()
        seen.append(rows(read_sentences(spark, str(at / "table")), "video_id", "sent_idx"))
    return seen


def test_stream_is_idempotent(spark, tmp_path):
    words = [("v", 0, "a", 0.0, 0.1, 1.0), ("v", 1, "b.", 0.2, 0.3, 1.0)]
    once, twice = stream_in(spark, tmp_path, [words, words])
    assert once == twice == [("v", 0, "a b.", 0.0, 0.3, 1.0)]


def test_stream_gives_the_sentences_of_one_batch(spark, tmp_path):
    r = random.Random(12)
    words, at = [], {v: 0.0 for v in "uvw"}
    for pos in range(120):
        for v in at:
            at[v] += r.choice([0.3, 0.3, 2.0])
            words.append((v, pos, r.choice(["one", "two", "three."]), round(at[v], 1), round(at[v] + 0.2, 1), 1.0))
    cuts = [0, 17, 40, 200, len(words)]
    late = [w for w in words if w[0] != "w"]
    batches = [late[a:b] for a, b in zip(cuts, cuts[1:])] + [[w for w in words if w[0] == "w"]]
    want = rows(sentences.group_sentences(spark.createDataFrame(words, WORDS)), "video_id", "sent_idx")
    assert stream_in(spark, tmp_path, batches)[-1] == want and len(want) > 60


def test_streamed_words_may_overlap_repeat_and_come_early(spark, tmp_path):
    r = random.Random(4)
    words, at = [], 0.0
    for pos in range(230):
        at += r.choice([0.3, 0.3, 0.3, 2.0])
        words.append(("v", pos, r.choice(["one", "two", "three", "four?"]) if pos < 150 else "on", round(at, 1), round(at + 0.2, 1), 0.5))
    batches = [words[:20], words[60:90], words[15:70], words[100:101], [w for w in words if r.random() < 0.5], words]
    seen = stream_in(spark, tmp_path, batches)
    whole = lambda n: rows(sentences.group_sentences(spark.createDataFrame(words[:n], WORDS)), "sent_idx")
    assert seen[0] == seen[1] == whole(20) and seen[2] == seen[3] == whole(90) and seen[5] == whole(230)


def test_a_stream_reads_no_word_again(spark, tmp_path):
    """The words of earlier batches are gone when later ones come."""
    from quillmap.streaming.ingest import ingest, read_sentences, stream_words

    made = [("v", k, "w", 0.3 * k, 0.3 * k + 0.1, 1.0) for k in range(130)]
    for n in range(0, 130, 26):
        at = tmp_path / "in" / f"part={n}"
        spark.createDataFrame(made[n : n + 26], WORDS).coalesce(1).write.parquet(str(at))
        ingest(stream_words(spark, str(tmp_path / "in" / "*")), str(tmp_path / "table"), str(tmp_path / "marks")).awaitTermination()
        for f in at.iterdir():
            f.unlink()
    got = rows(read_sentences(spark, str(tmp_path / "table")), "sent_idx")
    assert [len(x[2].split()) for x in got] == [50, 50, 30] and [x[3] for x in got] == [0.0, 15.0, 30.0]


def estimate_bits(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


@pytest.fixture(params=[0, 40, 100_000])
def rest(request, monkeypatch):
    """Edges that one task finishes: none, some after rounds, and all."""
    monkeypatch.setattr(traverse, "REST", request.param)


def test_components_of_a_long_chain(spark, rest):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = traverse.connected(chain)
    assert rows(found.agg(F.count("*"), F.max("component"))) == [(n + 1, 0)]
    assert estimate_bits(found) < 200


def test_components_agree_with_a_loop(spark, rest):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(400, k) for k in range(401, 440)] + [(500, 500), (None, 3)]
    label = list(range(501))
    for _ in range(500):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = rows(traverse.components(df, spark.range(501)), "id")
    assert got == list(enumerate(label))
    assert traverse.connected(df.limit(0)).isEmpty()


def test_topological_levels_of_a_long_chain(spark):
    edges = spark.range(25).select(F.format_string("n%02d", F.col("id") + 1).alias("src"), F.format_string("n%02d", "id").alias("dst"))
    got = traverse.topo_levels(edges, edges.select(F.col("src").alias("name")).union(edges.select("dst")))
    assert rows(got, "name") == [(f"n{k:02d}", k) for k in range(26)] and estimate_bits(got) < 400


def test_similar_pairs_agree_with_a_loop(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(90, 6)).astype(np.float32)
    x[7] = 0
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-10)[:, None]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if unit[i] @ unit[j] >= 0.5}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(95, None)], "idx long, embedding array<float>")
    for blocks in (0, 1, 7):
        got = rows(resolve.similar_pairs(df, 0.5, blocks))
        assert len(got) == len(want) and {g[:2] for g in got} == want
        assert all(abs(g[2] - unit[g[0]] @ unit[g[1]]) < 1e-9 for g in got)
    assert resolve.similar_pairs(df.limit(0), 0.5).isEmpty()


def test_questions_are_numbered_in_order(spark):
    pairs = [(k // 7, k % 7 + 100) for k in range(63)]
    got = rows(resolve.batched(spark.createDataFrame(pairs, "idx_a long, idx_b long").repartition(5)), "idx_a", "idx_b")
    assert got == [(*p, k // 10, k % 10) for k, p in enumerate(pairs)]


def test_times_find_their_segment(spark):
    r = random.Random(3)
    segs = [(v, f"{v}{k}", float(s := r.randint(0, 400)), s + float(r.choice([0, 1, 60, 61, 300]))) for v in "ab" for k in range(30)]
    times = [(v, float(t)) for v in "abc" for t in range(0, 700, 3)]
    want = sorted((v, t, min((s[2], s[1]) for s in hit)[1]) for v, t in times if (hit := [s for s in segs if s[0] == v and s[2] <= t < s[3]]))
    got = read_api.segment_at(spark.createDataFrame(times, "video_id string, t double"), spark.createDataFrame(segs, "video_id string, segment_id string, start double, end double"))
    assert rows(got, "video_id", "t") == want
