import pytest
from pyspark.sql import functions as F

from quillmap.functions import responses, text
from quillmap.functions.picks import best_definition, best_importance
from quillmap.functions.vector import cosine


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    names = {"Neural Networks": "neural network", "bus": "bus", "loss": "loss", "Biases": "bias", "Matrix-Vector Product": "matrix vector product", "boundaries": "boundary", "nodes": "nod", "types": "typ", "series": "sery", "axes": "axes", "layers": "layer", "  a  b_c ": "a b c"}
    assert apply(spark, list(names), text.normalize_name) == list(names.values())


def test_types(spark):
    assert apply(spark, ["Concept", " METHOD ", "theorem", "gadget", None], text.normalize_type) == ["definition", "technique", "theorem", "definition", "definition"]


@pytest.mark.parametrize(
    "a, b, kind, turned",
    [("Neural Network", "Neuron", "is_part_of", True), ("Neuron", "Neural Network", "is_part_of", False), ("Input Layer", "Neuron", "is_part_of", False), ("Hidden Layer", "Layer", "is_part_of", True), ("Weighted Sum", "Bias", "is_part_of", False), ("Neural Network", "Neuron", "depends_on", False)],
)
def test_direction(spark, a, b, kind, turned):
    assert spark.range(1).select(text.direction_reversed(F.lit(a), F.lit(b), F.lit(kind))).first()[0] is turned


def test_times(spark):
    assert apply(spark, [0.0, 59.9, 61.0, 3661.5], text.format_timestamp, "double") == ["00:00", "00:59", "01:01", "01:01:01"]
    assert apply(spark, [5.0, 61.0, 3661.5], text.format_clock, "double") == ["0:05", "1:01", "1:01:01"]


def test_sources(spark):
    assert apply(spark, ["https://www.youtube.com/watch?v=a", "youtu.be/x", "a/b.MP3", "a/b.mkv", "notes", "see youtu.be/x"], text.source_kind) == ["url", "url", "audio", "video", "missing", "missing"]
    assert apply(spark, ["a/b.c.mp4", "x"], text.stem) == ["b.c", "x"]


def test_excerpt_and_delay(spark):
    assert apply(spark, ["a" * 500, "a" * 501], text.excerpt) == ["a" * 500, "a" * 500 + "..."]
    assert apply(spark, ["Retry after 5.5s", "retry after 60", "429"], text.retry_delay) == [7.5, 30.0, 15.0]
    assert apply(spark, ["429 x", "429 insufficient_quota", "500"], text.classify_error) == ["retry", "quota", "raise"]


def test_fences(spark):
    bodies = ['[{"a":1}]', '```json\n[{"a":1}]\n```', '  ```\n[{"a":1}]\n```  ', '```\n[{"a":1}]']
    assert apply(spark, bodies, responses.strip_fence) == ['[{"a":1}]'] * 4


def test_concept_defaults(spark):
    got = apply(spark, ['[{"name":"x"}]'], responses.concepts)[0][0]
    assert got.asDict() == {"name": "x", "aliases": [], "type": "definition", "definition": "", "importance": "mentioned"}


def test_metadata_defaults(spark):
    got = apply(spark, ['{"title":"T","examples":[{"description":"d"}]}'], responses.metadata)[0]
    assert (got.title, got.examples[0].illustrates, got.key_quotes) == ("T", "", [])


def test_picks(spark):
    rows = [(1, 0, "short", "mentioned"), (1, 1, "longer one", "core"), (1, 2, "x" * 600, "core"), (2, 0, "", "supporting"), (2, 1, "valid", "mentioned"), (3, 0, "y" * 700, "other"), (3, 1, "z" * 800, "none")]
    df = spark.createDataFrame(rows, "g int, o int, d string, i string").groupBy("g").agg(best_definition(F.col("d"), F.col("o")).alias("d"), best_importance(F.col("i"), F.col("o")).alias("i")).orderBy("g")
    assert [tuple(r) for r in df.collect()] == [(1, "longer one", "core"), (2, "valid", "supporting"), (3, "y" * 700, "other")]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
