"""One place for the settings: the steps from words to answers, each with its settings, and what an application asks for by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import EngineConf
from .functions.text import excerpt, video_id
from .operators import attempts, extraction, knowledge, read_api, resolve, search, segmentation, sentences, traverse
from .operators.graph_store import TABLES, GraphStore
from .operators.iteration import cut
from .operators.read_api import NotFound
from .operators.vector_index import VectorIndex, build_index
from .sources.tables import exists, folders_of, replace_rows
from .streaming import ingest

@dataclass
class Engine:
    """A knowledge graph and a vector index under path, with settings that every step follows."""

    spark: SparkSession
    path: str
    conf: EngineConf = field(default_factory=EngineConf.from_env)

    # from words to knowledge

    def sentences(self, words: DataFrame) -> DataFrame:
        return sentences.group_sentences(sentences.scan_words(words), self.conf.max_words, self.conf.pause_seconds)

    def streamed_sentences(self, words: DataFrame) -> DataFrame:
        return ingest.stream_sentences(words, self.conf.max_words, self.conf.pause_seconds)

    def segments(self, sents: DataFrame, vectors: DataFrame) -> DataFrame:
        return segmentation.segment(sents, vectors, self.conf.min_segment_seconds, self.conf.max_segment_seconds, self.conf.smoothing_window)

    def knowledge(self, tried: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
        """The tables of GraphStore but videos, from attempts at model calls: extracted, cleaned of noise, by canonical names."""
        calls = cut(attempts.call_outcomes(tried, self.conf.attempts))
        outcomes = cut(attempts.segment_outcomes(calls, segments))
        responses = attempts.answered(calls, outcomes)
        found = extraction.extract_mentions(responses, segments)
        titled, examples, quotes = extraction.extract_metadata(responses, segments)
        related = extraction.extract_relationships(responses, segments, found).unionByName(extraction.global_relationships(responses, found))
        kept, left = knowledge.filter_noise(knowledge.normalize_types(found), related)
        mentions, relationships = knowledge.deduplicate(kept, left)
        owner = segments.select("segment_id", "video_id")
        return {
            "segments": titled, "mentions": mentions, "relationships": relationships, "concepts": knowledge.unique_concepts(mentions), "examples": examples.join(owner, "segment_id"),
            "quotes": quotes, "outcomes": outcomes, "summary": attempts.video_summary(calls, outcomes),
        }

    def resolve(self, concepts: DataFrame, vectors: DataFrame, verifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return resolve.resolve(concepts, vectors, verifier, self.conf.similarity_threshold, self.conf.verify_batch)

    # what is kept

    @property
    def store(self) -> GraphStore:
        return GraphStore(self.spark, f"{self.path}/graph")

    @property
    def index(self) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.path}/segments", "segment_id")

    def build(self, videos: DataFrame, told: dict[str, DataFrame], vectors: DataFrame) -> dict[str, int]:
        """Writes the graph tables of the videos and puts their segments in the index; how many of each. vectors: (segment_id, embedding)."""
        batch = {"videos": videos} | {name: told[name] for name in TABLES if name != "videos"}
        self.store.write(batch)
        rows = told["segments"].join(vectors, "segment_id").select("segment_id", "video_id", "title", F.col("transcript").alias("document"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = cut(rows)
        if exists(self.spark, f"{self.index.path}/cells"):
            self.index.upsert(rows)
        else:
            build_index(rows, self.index.path, "segment_id")
        return {name: batch[name].count() for name in TABLES} | {"indexed": rows.count()}

    def graph(self) -> dict[str, DataFrame]:
        return self.store.read()

    # what is asked

    def search(self, query: list[float], video: str | None = None, limit: int | None = None) -> DataFrame:
        """The hits of the index with their context from the graph, best first. query is an embedder's vector."""
        where = None if video is None else F.col("video_id") == video
        hits = cut(self.index.search(query, where, limit or self.conf.top_k)).withColumn("excerpt", excerpt(F.col("document"), self.conf.excerpt_chars)).drop("document")
        g = self.graph()
        return search.enrich(hits, g["explained_in"], g["concept_edges"], g["illustrates"], g["examples"]).orderBy(F.col("score").desc(), "segment_id")

    def prerequisites(self, name: str, max_depth: int | None = None) -> DataFrame:
        g = self.graph()
        return traverse.by_depth(traverse.prerequisites(self._needs(g), name, max_depth or self.conf.max_depth, g["concepts"], self._places(g)))

    def learning_path(self, target: str, known: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        g = self.graph()
        return traverse.learning_path(self._needs(g), target, list(known), self.conf.max_depth, g["concepts"], self._places(g))

    def _needs(self, g: dict[str, DataFrame]) -> DataFrame:
        return g["concept_edges"].filter("type = 'DEPENDS_ON'").select("src", "dst")

    def _places(self, g: dict[str, DataFrame]) -> DataFrame:
        return traverse.concept_locations(g["explained_in"], g["segments"], g["belongs_to"], g["videos"])

    def add_video(self, source: str) -> DataFrame:
        """A video that waits to be processed, under the id that its source gives. One that is there already starts anew."""
        made = self.spark.createDataFrame([(source,)], "source string").select(video_id(F.col("source")).alias("video_id"), F.col("source").alias("title"), "source", F.lit(0.0).alias("duration"), F.lit("pending").alias("status"))
        return self._put_videos(made)

    def set_status(self, video: str, status: str) -> DataFrame:
        mine = self.store.table("videos").filter(F.col("video_id") == video)
        if mine.isEmpty():
            raise NotFound(video)
        return self._put_videos(mine.withColumn("status", F.lit(status)))

    def _put_videos(self, rows: DataFrame) -> DataFrame:
        """Videos in place of what they were; all else that they have stays."""
        rows, store = cut(rows), self.store
        if exists(self.spark, f"{store.path}/videos"):
            rows = rows.select(store.table("videos").columns)
        owners = rows.select("video_id")
        replace_rows(rows, f"{store.path}/videos", "video_id", owners, folders_of(owners, "video_id", store.parts), store.parts)
        return rows

    def route(self, method: str, path: str, **given) -> dict[str, DataFrame]:
        """What an application's address gives, as named frames; NotFound where there is nothing, ValueError where a parameter is out of bounds."""
        for verb, pattern, answer in ROUTES:
            m = re.fullmatch(pattern, path)
            if verb == method and m:
                return answer(self, *m.groups(), **given)
        raise NotFound(f"{method} {path}")


def _detail(e: Engine, name: str) -> dict[str, DataFrame]:
    g = e.graph()
    return read_api.concept_detail(name, g["concepts"], g["concept_edges"], g["explained_in"], g["segments"], g["videos"])


def _needed(e: Engine, name: str, max_depth: int = 10) -> dict[str, DataFrame]:
    found = e.prerequisites(name, max_depth)
    return {"prerequisites": found, "summary": traverse.depth_summary(found)}


def _path(e: Engine, target_concept: str, known_concepts: list[str] = ()) -> dict[str, DataFrame]:
    steps, header = e.learning_path(target_concept, known_concepts)
    return {"steps": steps.orderBy("position"), "header": header}


def _process(e: Engine, video: str) -> dict[str, DataFrame]:
    return {"videos": e.set_status(video, "processing")}


def _page(e: Engine, skip: int = 0, limit: int = 50) -> dict[str, DataFrame]:
    g = e.graph()
    nodes, edges = read_api.graph_page(g["concepts"], g["concept_edges"], skip, limit)
    return {"nodes": nodes, "edges": edges}


#: Method, address and what it gives.
ROUTES = [
    ("GET", "/health", lambda e: {"health": e.spark.createDataFrame([("ok",)], "status string")}),
    ("POST", "/videos", lambda e, source: {"videos": e.add_video(source)}),
    ("GET", "/videos", lambda e: {"videos": read_api.list_videos(e.store.table("videos"))}),
    ("GET", "/videos/([^/]+)/segments", lambda e, video: {"segments": read_api.segment_defaults(read_api.video_segments(video, e.store.table("segments")))}),
    ("POST", "/videos/([^/]+)/process", _process),
    ("GET", "/graph/concepts", lambda e, skip=0, limit=50: {"concepts": read_api.concept_defaults(read_api.list_concepts(e.store.concepts(), skip, limit))}),
    ("GET", "/graph/data", _page),
    ("GET", "/graph/concepts/([^/]+)", _detail),
    ("GET", "/graph/concepts/([^/]+)/prerequisites", _needed),
    ("POST", "/search", lambda e, query, video_id=None, limit=10: {"results": e.search(query, video_id, limit)}),
    ("POST", "/learning-path", _path),
]
