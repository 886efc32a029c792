import json

import pytest
from pyspark.sql import functions as F

from quillmap.conf import EngineConf
from quillmap.engine import ROUTES, Engine
from quillmap.operators.read_api import NotFound
from quillmap.schemas import RESULT, WORDS
from quillmap.sources import documents as sources

from .test_operators import rows

ATTEMPTS = "video_id string, seg_no int, segment_id string, kind string, attempt int, error string, body string"


def words_of(video, topics, n=30):
    """n words for each topic, ten to a sentence."""
    out, pos = [], 0
    for t in topics:
        for k in range(n):
            out.append((video, pos, f"{t}{k}" + ("." if k % 10 == 9 else ""), 4.0 * pos, 4.0 * pos + 0.5, 1.0))
            pos += 1
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An engine over two videos whose topics are told apart by the vectors of their sentences."""
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), EngineConf(min_segment_seconds=60.0, smoothing_window=1, pause_seconds=9.0, excerpt_chars=12, top_k=2))
    words = words_of("v1", ["vector", "matrix", "tensor"]) + words_of("v2", ["limit", "series"])
    sents = e.sentences(spark.createDataFrame(words, WORDS))
    axes = {t: [float(k == i) for i in range(5)] for k, t in enumerate(["vector", "matrix", "tensor", "limit", "series"])}
    vectors = spark.createDataFrame([(r.video_id, r.sent_idx, axes[r.text.rstrip(".").split()[0].rstrip("0123456789")]) for r in sents.collect()], "video_id string, sent_idx long, embedding array<double>")
    segments = e.segments(sents, vectors)
    names = {r.segment_id: r.transcript.split()[0].rstrip("0123456789") for r in segments.collect()}
    tried = []
    for s, topic in names.items():
        concepts = [{"name": topic.title(), "definition": f"what {topic} is", "importance": "core", "type": "concept"}, {"name": "Number", "aliases": ["numbers"], "definition": "a number"}]
        bodies = {"concepts": concepts, "relationships": [{"from_concept": topic.title(), "to_concept": "numbers", "type": "depends_on", "evidence": s}], "metadata": {"title": f"About {topic}", "examples": [{"description": f"a {topic}", "illustrates": topic.title()}]}}
        for kind, body in bodies.items():
            tried += [(s.split("_")[0], int(s[-3:]), s, kind, 1, "429 wait", None), (s.split("_")[0], int(s[-3:]), s, kind, 2, None, "```json\n" + json.dumps(body) + "\n```")]
    tried.append(("v1", None, "global", "global", 1, None, json.dumps([{"from_concept": "Tensor", "to_concept": "Matrix"}, {"from_concept": "Matrix", "to_concept": "Vector"}])))
    told = e.knowledge(spark.createDataFrame(tried, ATTEMPTS), segments)
    videos = spark.createDataFrame([("v1", "Algebra", "a.mp4", 360.0, "completed"), ("v2", "Analysis", "b.mp4", 240.0, None)], "video_id string, title string, source string, duration double, status string")
    counts = e.build(videos, told, spark.createDataFrame([(s, axes[t]) for s, t in names.items()], "segment_id string, embedding array<double>"))
    return e, axes, counts, told


def test_a_build_counts_what_it_wrote(built):
    _, _, counts, told = built
    assert counts == {"videos": 2, "segments": 5, "concepts": 7, "mentions": 10, "relationships": 7, "examples": 5, "indexed": 5}
    assert rows(told["summary"].select("video_id", "done", "waited"), "video_id") == [("v1", 3, 135.0), ("v2", 2, 90.0)]


def test_search_follows_the_settings(built):
    e, axes, *_ = built
    got = e.search(axes["matrix"]).collect()
    assert len(got) == 2 and got[0].segment_id == "v1_seg002" and got[0].excerpt == "matrix0 matr..." and got[0].concepts == ["Matrix", "Number"]
    assert got[0].prerequisites == ["Number", "Vector"] and got[0].examples == ["a matrix"]
    assert [r.segment_id for r in e.search(axes["matrix"], "v2", 1).collect()] == ["v2_seg001"]


def test_paths_go_by_the_greatest_depth(built):
    e, *_ = built
    assert rows(e.prerequisites("Tensor").select("name", "depth")) == [("Matrix", 1), ("Number", 1), ("Vector", 2)]
    assert [r.name for r in Engine(e.spark, e.path, EngineConf(max_depth=1)).prerequisites("Tensor").collect()] == ["Matrix", "Number"]
    steps, header = e.learning_path("Tensor", ["Number"])
    assert [r.name for r in steps.orderBy("position").collect()] == ["Vector", "Matrix", "Tensor"] and header.first()["skipped"] == ["Number"]


def test_addresses(built):
    e, axes, *_ = built
    got = lambda method, path, **given: {k: rows(v) for k, v in e.route(method, path, **given).items()}
    assert got("GET", "/health") == {"health": [("ok",)]}
    assert [(r[0], r[4]) for r in got("GET", "/videos")["videos"]] == [("v1", "completed"), ("v2", "completed")]
    assert len(got("GET", "/videos/v1/segments")["segments"]) == 3 and len(got("GET", "/graph/concepts", limit=3)["concepts"]) == 3
    assert got("GET", "/graph/concepts/Matrix/prerequisites", max_depth=1)["summary"] == [(2, 1)]
    assert set(got("GET", "/graph/concepts/Matrix")) == {"concept", "relations", "segments"} and len(got("GET", "/graph/data")["nodes"]) == 6
    assert len(got("POST", "/search", query=axes["limit"], limit=1)["results"]) == 1 and len(got("POST", "/learning-path", target_concept="Tensor")["steps"]) == 4
    for wrong in (("GET", "/nothing"), ("PUT", "/videos"), ("GET", "/graph/concepts/none"), ("GET", "/videos/none/segments"), ("POST", "/videos/none/process")):
        with pytest.raises(NotFound):
            e.route(*wrong)
    for given in ({"limit": 0}, {"skip": -1}, {"limit": 201}):
        with pytest.raises(ValueError):
            e.route("GET", "/graph/concepts", **given)
    with pytest.raises(ValueError):
        e.route("GET", "/graph/concepts/Matrix/prerequisites", max_depth=21)
    assert len(ROUTES) == 11


def test_a_new_video_waits_and_is_processed(built):
    e, *_ = built
    new = e.route("POST", "/videos", source="https://youtu.be/x")["videos"].first()
    assert new.video_id.startswith("vid_") and (new.title, new.status, new.duration) == ("https://youtu.be/x", "pending", 0.0)
    assert e.route("POST", f"/videos/{new.video_id}/process")["videos"].first().status == "processing"
    assert [r.status for r in e.route("GET", "/videos")["videos"].collect()].count("processing") == 1 and e.store.table("segments").count() == 5


def test_settings_of_a_file(tmp_path):
    (tmp_path / "env").write_text("# settings\nMAX_WORDS = 7\nTOP_K='3'\nOTHER=x\n\nnonsense\n")
    assert EngineConf.from_file(str(tmp_path / "env"), {"TOP_K": "4"}) == EngineConf(max_words=7, top_k=4)


def test_sentences_follow_the_settings(spark, tmp_path):
    words = spark.createDataFrame(words_of("v", ["w"], 9), WORDS)
    assert Engine(spark, str(tmp_path), EngineConf(max_words=4, pause_seconds=9.0)).sentences(words).count() == 3
    assert Engine(spark, str(tmp_path), EngineConf(pause_seconds=1.0)).sentences(words).count() == 9


def test_templates_are_read_once(spark, tmp_path):
    (tmp_path / "ask.txt").write_text("Title: {title}\nText")
    t = sources.Templates(spark, str(tmp_path))
    assert t["ask"] == "Title: {title}\nText"
    (tmp_path / "ask.txt").write_text("new")
    assert t["ask"].startswith("Title") and sources.Templates(spark, str(tmp_path))["ask"] == "new"
    with pytest.raises(KeyError):
        t["none"]


def test_bad_documents_are_set_aside(spark, tmp_path):
    one = ("v", "T", "src", 9.0, [("s", "v", "S", 0.0, 1.0, "t")], [("s", "S", (0.0, 1.0), [("n", ["a"], "t", "d", "core", None)], [("a", "b", "t", "e")], [("d", "n", None)], [("q", 1.0, "r")])], [])
    df = spark.createDataFrame([one, ("w", "T2", "src", 1.0, [], [], [])], RESULT)
    at = tmp_path / "out"
    sources.write_results(df, str(at))
    whole = json.loads(df.filter("video_id = 'v'").select(F.to_json(F.struct("*"))).first()[0])
    bad = {
        "cut": json.dumps(whole)[:-20], "kind": json.dumps(whole | {"duration": "long"}), "absent": json.dumps({k: v for k, v in whole.items() if k != "source"}), "empty": "", "list": "[1]",
        "blank": " ", "inside": json.dumps(whole | {"segments": [{"id": "s", "title": "x", "start": 5.0, "end": 1.0, "transcript": None}]}),
    }
    for name, body in bad.items():
        (at / f"{name}.json").write_text(body)
    (at / "spread.json").write_text(json.dumps(whole | {"video_id": "x"}, indent=2))
    good, aside = sources.read_checked(spark, str(at))
    assert sorted(r.video_id for r in good.collect()) == ["v", "w", "x"] and good.filter("video_id = 'v'").collect() == df.filter("video_id = 'v'").collect() and good.columns == df.columns
    told = {r.file.split("/")[-1].split(".")[0]: r.problems for r in aside.collect()}
    broken = ["not a document of the schema"]
    assert told == {"cut": broken, "kind": broken, "list": broken, "blank": broken, "absent": ["source is absent"], "inside": ["segments[0].transcript is absent", "segments[0] ends before it starts"]}
    assert all(x.isEmpty() for x in sources.read_checked(spark, str(tmp_path / "none")))
