"""Vector tables and semantic search with its context from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import concept_id, excerpt
from ..functions.vector import score
from .graph import upsert
from .iteration import cut

NOT_RELATED = ["DEPENDS_ON", "EXPLAINED_IN"]
#: Rows that a side has at most to be broadcast.
FEW = 10_000


def index_segments(existing: DataFrame, segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """vec_segments with the segments' rows put in; vectors: (segment_id, embedding)."""
    new = segments.join(vectors, "segment_id").withColumns({"id": F.col("segment_id"), "document": F.col("transcript")})
    return upsert(existing, new, ["id"], [c for c in existing.columns if c != "id"])


def index_concepts(existing: DataFrame, concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """vec_concepts; ids come from normalised names, so of names that agree the last one stays."""
    new = concepts.join(vectors, "name").withColumns({"id": concept_id(F.col("name")), "document": F.concat_ws(": ", "name", "definition"), "aliases": F.to_json("aliases")})
    return upsert(existing, new, ["id"], [c for c in existing.columns if c != "id"], order="name")


def index_result(segments: DataFrame, segment_vectors: DataFrame, concepts: DataFrame, concept_vectors: DataFrame, old_segments: DataFrame, old_concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables with a result's rows put in, and a row of counts (segments, concepts): how many of the result were indexed."""
    counts = segments.join(segment_vectors, "segment_id").agg(F.count("*").alias("segments")).crossJoin(concepts.join(concept_vectors, "name").agg(F.count("*").alias("concepts")))  # one row each
    return index_segments(old_segments, segments, segment_vectors), index_concepts(old_concepts, concepts, concept_vectors), counts


def vector_search(vectors: DataFrame, query: list[float], where=None, k: int = 10, id_col: str = "id") -> DataFrame:
    """The k rows nearest to the query by max(0, cosine), exactly. The filter and the columns reach the scan; each partition keeps k rows."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", score(F.col("embedding"), q)).drop("embedding").orderBy(F.col("score").desc(), id_col).limit(k)


def enrich(hits: DataFrame, explained_in: DataFrame, concept_edges: DataFrame, illustrates: DataFrame, examples: DataFrame) -> DataFrame:
    """Adds to each hit (segment_id) its concepts, their prerequisites, related concepts and examples.

    What the graph says of a concept is one list of facts, of three kinds, so each table is read once. The
    concepts of the hits are written and counted; few of them are broadcast to the facts, many are joined
    with these by shuffles. One aggregation for each segment then sorts the facts by kind.
    """
    here = cut(explained_in.select("segment_id", "concept").join(few(hits.select("segment_id").distinct()), "segment_id"))
    out = concept_edges.withColumn("kind", F.when(F.col("type") == "DEPENDS_ON", "prerequisites").when(~F.col("type").isin(NOT_RELATED), "related")).filter("kind IS NOT NULL").select(F.col("src").alias("concept"), "kind", F.col("dst").alias("fact"))
    known = few(here)
    mine = known.select("concept").distinct()
    told = illustrates.join(mine, "concept", "left_semi").join(examples.select("example_id", "description"), "example_id").select("concept", F.lit("examples").alias("kind"), F.col("description").alias("fact"))
    facts = out.unionByName(told).join(known, "concept").select("segment_id", "kind", "fact").unionByName(here.select("segment_id", F.lit("concepts").alias("kind"), F.col("concept").alias("fact")))
    of_kind = lambda kind: F.when(F.col("kind") == kind, F.col("fact"))
    lists = facts.groupBy("segment_id").agg(F.array_sort(F.collect_list(of_kind("concepts"))).alias("concepts"), *[F.array_sort(F.collect_set(of_kind(k))).alias(k) for k in ("prerequisites", "related", "examples")])
    return hits.join(lists, "segment_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("concepts", "prerequisites", "related", "examples")})


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted to have FEW rows at most."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def search(vec_segments: DataFrame, query: list[float], graph: dict[str, DataFrame], video_id: str | None = None, k: int = 10, chars: int = 500) -> DataFrame:
    hits = cut(vector_search(vec_segments, query, None if video_id is None else F.col("video_id") == video_id, k, "segment_id"))
    found = enrich(hits.withColumn("excerpt", excerpt(F.col("document"), chars)).drop("document"), graph["explained_in"], graph["concept_edges"], graph["illustrates"], graph["examples"])
    return found.orderBy(F.col("score").desc(), "segment_id")
