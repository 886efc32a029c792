"""Results as JSON documents, lists of sources as text, and word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, source_kind, stem, video_id
from ..schemas import RESULT, WORDS
from .tables import PARTS, exists, replace_rows, rows_of


def write_results(results: DataFrame, path: str) -> None:
    """One folder per video, overwritten. A folder costs much, so many documents go by write_documents()."""
    results.withColumn("video", F.col("video_id")).write.mode("overwrite").partitionBy("video").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the fixed schema; a malformed one fails the read, a missing path gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


#: What a document must tell: fields of its own, and of the elements of its lists.
REQUIRED = {"": ["video_id", "title", "source", "duration"], "segments": ["id", "title", "start", "end", "transcript"], "knowledge_units": ["segment_id", "segment_title"], "concepts": ["name", "type", "definition", "importance"]}


def problems_of(doc: Column) -> Column:
    """What is wrong with a document of the schema RESULT, as texts: absent fields, and times that run backwards."""
    absent = [F.when(doc[c].isNull(), f"{c} is absent") for c in [*REQUIRED[""], *[k for k in REQUIRED if k]]]
    at = lambda name, k, told: F.concat(F.lit(f"{name}["), k, F.lit(f"]{told}"))
    each = lambda name, c: F.transform(F.coalesce(doc[name], F.array()), lambda x, k: F.when(x[c].isNull(), at(name, k, f".{c} is absent")))
    inside = [each(name, c) for name, fields in REQUIRED.items() if name for c in fields]
    turned = F.transform(F.coalesce(doc["segments"], F.array()), lambda x, k: F.when(x["start"] > x["end"], at("segments", k, " ends before it starts")))
    return F.filter(F.concat(F.array(*absent), *inside, turned), lambda p: p.isNotNull())


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound documents, of the schema RESULT, and the others: (file, problems, body).

    Each file is one document. One that isn't JSON, or whose fields have other types, is set aside with the
    rest of those with problems, so it stops nobody else's. An empty file holds no document; a missing path
    gives no rows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], RESULT), spark.createDataFrame([], "file string, problems array<string>, body string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("body"))
    good, bad = _checked(raw)
    return good.drop("file"), bad.select("file", "problems", "body")


def _checked(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw: rows with body. The fields of the sound ones, with raw's other columns, and the rest with problems."""
    read = F.from_json("body", f"{RESULT}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = lambda doc: doc.isNull() | doc["_corrupt"].isNotNull()
    judged = lambda doc: F.struct(doc.alias("doc"), F.when(broken(doc), F.array(F.lit("not a document of the schema"))).otherwise(problems_of(doc)).alias("problems"))
    found = raw.withColumn("read", let(read, judged)).select(*raw.columns, "read.doc", "read.problems")  # a body is parsed once for all that is asked of it
    bad = F.size("problems") > 0
    return found.filter(~bad).select(*[c for c in raw.columns if c not in ("body", "video_id")], "doc.*").drop("_corrupt"), found.filter(bad).drop("doc")


def write_documents(documents: DataFrame, path: str, parts: int = PARTS) -> None:
    """documents: (video_id, body). A row for each, in `parts` folders by a hash of the video, which take the place of what the videos had: files don't grow in number with videos."""
    owners = documents.select("video_id")
    replace_rows(documents.select("video_id", "body"), path, "video_id", owners, list(range(parts)), parts)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound documents of a table of write_documents(), of the schema RESULT, and the others: (video_id, problems, body)."""
    good, bad = _checked(rows_of(spark, path, "video_id string, body string, part int").select("video_id", "body"))
    return good, bad.select("video_id", "problems", "body")


class Templates:
    """Prompt templates of a folder, each read once, as name.txt, from wherever Spark can read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.read = spark, folder, {}

    def __getitem__(self, name: str) -> str:
        if name not in self.read:
            path = f"{self.folder}/{name}.txt"
            if not exists(self.spark, path):
                raise KeyError(name)
            found = self.spark.read.text(path, wholetext=True).first()
            self.read[name] = found[0] if found else ""
        return self.read[name]


def parse_source_list(lines: DataFrame) -> DataFrame:
    """lines: (value). Trimmed lines that aren't blank or comments."""
    t = F.trim("value")
    return lines.select(t.alias("source")).filter((F.length("source") > 0) & ~F.col("source").startswith("#"))


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_source_list(spark.read.text(path))


def describe_sources(sources: DataFrame) -> DataFrame:
    """(source, video_id, kind, title): the title is the stem of a file and comes from elsewhere for an address."""
    kind = source_kind(F.col("source"))
    return sources.select("source", video_id(F.col("source")).alias("video_id"), kind.alias("kind"), F.when(kind.isin("audio", "video"), stem(F.col("source"))).alias("title"))


def gather_sources(*parts: DataFrame, most: int | None = None) -> DataFrame:
    """Parts one after the other, in order and with repeats; the first `most` of them if given. Each part: (ordinal, source)."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), "ordinal", "source")
        out = p if out is None else out.unionByName(p)
    return out.orderBy("part", "ordinal") if most is None else out.orderBy("part", "ordinal").limit(most)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)
