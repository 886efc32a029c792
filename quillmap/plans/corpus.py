"""The engine's tables, derived from the driver's tables.

Each view is SQL that Spark and DuckDB read alike, with {table} for what it reads, so queries and
their oracles start from the same rows.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iteration import dealt

#: The order of an order's lines, and the name that a line gives its part.
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"
LINE_NAME = "CASE l_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') ELSE concat(p_name, 's') END"
LINE_REST = """concat(p_name, ' ', p_brand) AS alias,
               CASE l_suppkey % 6 WHEN 0 THEN 'Concept' WHEN 1 THEN ' method' WHEN 2 THEN 'Layer' WHEN 3 THEN 'theorem' WHEN 4 THEN 'gadget' ELSE 'METRIC ' END AS type,
               CASE WHEN l_partkey % 50 = 7 THEN 'Please Subscribe to it' WHEN l_partkey % 50 = 8 THEN '' ELSE concat(p_brand, ' ', p_type, ' no ', p_partkey, repeat(' x', cast(p_partkey % 7 AS int))) END AS definition,
               CASE WHEN p_size < 17 THEN 'core' WHEN p_size < 34 THEN 'supporting' ELSE 'mentioned' END AS importance"""
#: Names that several videos' mentions share, and aliases that cross.
CROSSING_NAME = "CASE WHEN (seg_no + pos) % 5 = 1 THEN concat('tag ', (seg_no * 3 + pos) % 9) ELSE name END"
CROSSING_ALIAS = "CASE WHEN pos % 2 = 0 THEN concat('Tag-', (seg_no + pos) % 9) WHEN pos % 3 = 0 THEN concat('tag ', (seg_no * 2 + pos) % 9, 's') END"
RELATION = "CASE pos % 3 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'is_part_of' ELSE 'applies_to' END AS type, concat('line ', pos) AS evidence"

VIEWS = {
    "videos": """
        SELECT concat('v', c_custkey) AS video_id, c_name AS title, concat('media/', c_name, CASE c_custkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.wav' ELSE '.MP3' END) AS source,
               c_acctbal AS duration, CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status
        FROM {customer}""",
    "segments": """
        SELECT concat('s', o_orderkey) AS segment_id, concat('v', o_custkey) AS video_id, cast(o_orderkey AS int) AS seg_no, concat('Segment ', o_orderkey) AS title,
               cast((o_orderkey % 997) * 10 AS double) AS t0, cast((o_orderkey % 997) * 10 + 5 + floor(o_totalprice / 10000) AS double) AS t1
        FROM {orders}""",
    "mentions": f"""
        SELECT concat('v', o_custkey) AS video_id, cast(l_orderkey AS int) AS seg_no, concat('s', l_orderkey) AS segment_id,
               cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS int) AS pos,
               {LINE_NAME} AS name,
               {LINE_REST}
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
    "crossing": f"""
        SELECT video_id, seg_no, segment_id, pos, {CROSSING_NAME} AS name, alias AS alias1,
               {CROSSING_ALIAS} AS alias2, type, definition, importance
        FROM {{mentions}}""",
    "relationships": f"""
        SELECT * FROM (
            SELECT video_id, seg_no, segment_id, pos, name AS from_concept, lead(name) OVER (PARTITION BY seg_no ORDER BY pos) AS to_concept,
                   {RELATION}
            FROM {{mentions}}) m
        WHERE to_concept IS NOT NULL""",
    "concepts": """
        SELECT concat(p_name, ' #', p_partkey) AS name, p_partkey AS id, p_type AS type, concat(p_brand, ' ', p_type) AS definition,
               CASE WHEN p_size < 17 THEN 'core' WHEN p_size < 34 THEN 'supporting' ELSE 'mentioned' END AS importance
        FROM {part}""",
    "explained_in": """
        SELECT DISTINCT concat(p_name, ' #', p_partkey) AS concept, concat('s', l_orderkey) AS segment_id, concat('v', o_custkey) AS video_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "id_edges": """
        SELECT a, b, type, concat('from ', a) AS evidence FROM (
            SELECT p_partkey AS a, cast(floor(p_partkey / 2) AS bigint) AS b, 'DEPENDS_ON' AS type FROM {part} WHERE p_partkey >= 1
            UNION SELECT p_partkey, cast(floor(p_partkey / 3) AS bigint), 'DEPENDS_ON' FROM {part} WHERE p_partkey >= 1
            UNION SELECT p_partkey, (p_partkey + 7) % (SELECT count(*) FROM {part}), CASE p_partkey % 3 WHEN 0 THEN 'APPLIES_TO' WHEN 1 THEN 'EXTENDS' ELSE 'IS_PART_OF' END FROM {part}) e""",
    "concept_edges": """
        SELECT x.name AS src, y.name AS dst, e.type, e.evidence FROM {id_edges} e JOIN {concepts} x ON e.a = x.id JOIN {concepts} y ON e.b = y.id""",
    "cyclic_edges": """
        SELECT src, dst FROM {concept_edges} WHERE type = 'DEPENDS_ON'
        UNION SELECT x.name, y.name FROM {concepts} x JOIN {concepts} y ON y.id = x.id + 90 WHERE x.id % 10 = 3 AND x.id < 60""",
    "examples": """
        SELECT concat('e', event_id) AS example_id, concat('s', event_id % 97) AS segment_id, concat(event_type, ' by ', user_id) AS description, user_id AS concept_id FROM {events}""",
    "illustrates": """
        SELECT example_id, name AS concept FROM {examples} e JOIN {concepts} c ON c.id = e.concept_id""",
    "responses": """
        SELECT concat('v', o_custkey) AS video_id, concat('s', o_orderkey) AS segment_id, 'concepts' AS kind, CASE WHEN o_orderkey % 7 = 0 THEN '[]' ELSE
               concat('[{{"name":"c', o_orderkey % 50, '","type":"model"}},{{"name":"d', o_orderkey % 11, '","definition":"told","importance":"core"}}]') END AS body FROM {orders}
        UNION ALL SELECT concat('v', o_custkey), concat('s', o_orderkey), 'relationships', concat('[{{"from_concept":"c', o_orderkey % 50, '","to_concept":"d', o_orderkey % 11, '"', CASE WHEN o_orderkey % 2 = 0 THEN ',"type":"extends"' ELSE '' END, '}}]') FROM {orders}
        UNION ALL SELECT concat('v', o_custkey), concat('s', o_orderkey), 'metadata', CASE WHEN o_orderkey % 3 = 0 THEN '{{"examples":[]}}' ELSE concat('{{"title":"About ', o_orderkey, '","examples":[{{"description":"e', o_orderkey % 5, '"}}]}}') END FROM {orders}
        UNION ALL SELECT concat('v', c_custkey), 'global', 'global', '[{{"from_concept":"c1","to_concept":"d1","evidence":"across"}}]' FROM {customer}""",
    "attempts": """
        SELECT video_id, seg_no, segment_id, kind, attempt, error, CASE WHEN error IS NULL THEN CASE WHEN h % 13 = 5 THEN 'none' ELSE body END END AS body FROM (
            SELECT *, CASE WHEN h % 97 = 0 THEN CASE attempt WHEN 1 THEN '429 Retry after 2.5s' WHEN 2 THEN '400 insufficient_quota' END
                           WHEN h % 20 < 14 THEN CASE WHEN attempt > 1 THEN '500 late' END
                           WHEN h % 20 = 14 THEN CASE WHEN attempt = 1 THEN concat('429 retry after ', h % 50) END
                           WHEN h % 20 = 15 THEN CASE WHEN attempt <= 2 THEN '429 busy' END
                           WHEN h % 20 = 16 THEN '429 retry after 1'
                           WHEN h % 20 = 17 THEN CASE WHEN attempt = 1 THEN '500 server error' END
                           WHEN h % 20 = 18 THEN CASE WHEN attempt = 1 THEN '429 wait' END
                           ELSE '429 wait' END AS error
            FROM (SELECT r.video_id, seg_no, r.segment_id, kind, body, attempt, coalesce(seg_no, cast(substring(r.video_id, 2) AS int)) * 3 + length(kind) AS h
                  FROM {responses} r LEFT JOIN {segments} s ON s.segment_id = r.segment_id, (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t) c
            WHERE h % 20 <> 19 OR attempt = 1) e""",
    "sentence_vectors": """
        SELECT concat('v', label) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sent_idx, vec_id, embedding FROM {embeddings}""",
    "sentences": """
        SELECT video_id, sent_idx, concat('sentence ', vec_id, '.') AS text, cast(sent_idx * 20 + vec_id % 5 AS double) AS t0, cast(sent_idx * 20 + 15 + vec_id % 4 AS double) AS t1, cast(0.5 AS double) AS confidence
        FROM {sentence_vectors}""",
}

NEXT_NAME = LINE_NAME.replace("l_partkey", "next_partkey").replace("p_name", "next_name")
LINED = f"""SELECT video_id, cast(l_orderkey AS int) AS seg_no, concat('s', l_orderkey) AS segment_id, pos, {LINE_NAME} AS name, {LINE_REST}, CASE WHEN next_name IS NOT NULL THEN {NEXT_NAME} END AS to_concept
             FROM (SELECT *, l_partkey AS p_partkey FROM {{placed}}) l"""

#: Views that Spark makes from other text with the same rows. Lines get their parts first, so that one shuffle by l_orderkey, of
#: which seg_no is the number, serves the join with orders and the windows; texts are made after it. Both views shuffle the same columns, unless more are read, so a
#: query of both does so once. lined has both, a relationship in the row of the mention at which it begins. spoken has crossing mentions and the relationships that begin at them; its texts are made after lines are dealt by
#: their video, so that what is shuffled are numbers and names of parts.
MADE = {
    "named": "SELECT * FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "mentions": f"""
        SELECT concat('v', o_custkey) AS video_id, cast(l_orderkey AS int) AS seg_no, concat('s', l_orderkey) AS segment_id, pos, {LINE_NAME} AS name, {LINE_REST}
        FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS int) AS pos FROM {{named}} JOIN {{orders}} ON l_orderkey = o_orderkey) m""",
    "relationships": f"""
        SELECT concat('v', o_custkey) AS video_id, cast(l_orderkey AS int) AS seg_no, concat('s', l_orderkey) AS segment_id, pos, {LINE_NAME} AS from_concept,
               {NEXT_NAME} AS to_concept,
               {RELATION}
        FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS int) AS pos, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS next_partkey,
                     lead(p_name) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS next_name
              FROM {{named}} JOIN {{orders}} ON l_orderkey = o_orderkey) m
        WHERE next_name IS NOT NULL""",
    "placed": f"""
        SELECT concat('v', o_custkey) AS video_id, l_orderkey, l_partkey, l_suppkey % 6 AS l_suppkey, p_name, p_brand, p_type, p_size, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS int) AS pos,
               lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS next_partkey, lead(p_name) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS next_name
        FROM {{named}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "spoken": f"""
        SELECT video_id, seg_no, pos, struct({CROSSING_NAME} AS name, array(alias, {CROSSING_ALIAS}) AS aliases, type, definition, segment_id, importance) AS m,
               CASE WHEN to_concept IS NOT NULL THEN struct(segment_id, name AS from_concept, to_concept, {RELATION}) END AS r
        FROM ({LINED}) t""",
    "lined": LINED,
}
#: Views whose windows go by a key: these rows are dealt by it, so that a task sorts so many whatever the input.
DEALT = {"mentions": ("named", "l_orderkey"), "relationships": ("named", "l_orderkey"), "placed": ("named", "l_orderkey"), "spoken": ("placed", "video_id")}


def _reads(name: str, texts: dict[str, str] = VIEWS) -> list[str]:
    return re.findall(r"\{(\w+)\}", texts[name])


@cache
def ctes(*names: str) -> str:
    """WITH clause for DuckDB that defines the views and those that they read; the driver's tables are there already."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in order:
            for r in _reads(n):
                need(r)
            order.append(n)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**{r: r for r in _reads(n)})})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables, as a frame; t0 and t1 are its start and end."""
    if name not in VIEWS and name not in MADE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    texts = MADE if name in MADE else VIEWS
    tables = {r: _raw(spark, sf_dir, r) for r in set(_reads(name, texts))}
    if name in DEALT:
        table, key = DEALT[name]
        tables[table] = dealt(tables[table], mentions_at_most(spark, sf_dir), key)
    raw = spark.sql(texts[name], **tables)
    return raw.withColumnsRenamed({"t0": "start", "t1": "end"})


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name).withColumnsRenamed({"start": "t0", "end": "t1"})


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_aliases(view(spark, sf_dir, "mentions"))


def with_aliases(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"aliases": F.array("alias"), "timestamp_range": F.lit(None).cast("struct<start:double,end:double>")}).drop("alias")


def relationships_of(lined: DataFrame) -> DataFrame:
    """The rows of the view relationships, each of which begins at a line."""
    return lined.sparkSession.sql(f"SELECT video_id, seg_no, segment_id, pos, name AS from_concept, to_concept, {RELATION} FROM {{lined}} WHERE to_concept IS NOT NULL", lined=lined)


def mentions_at_most(spark: SparkSession, sf_dir: str) -> int:
    """The number of lines, each of which is a mention if its order and part are there."""
    return view(spark, sf_dir, "lineitem").count()


def crossing_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions some of whose names and aliases cross, so that the order of a video's mentions decides."""
    c = view(spark, sf_dir, "crossing")
    return c.withColumns({"aliases": F.array("alias1", "alias2"), "timestamp_range": F.lit(None).cast("struct<start:double,end:double>")}).drop("alias1", "alias2")


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, w): the words of each document."""
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return view(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), split.alias("w"))


def placed_words(split: DataFrame) -> DataFrame:
    """Words of split_texts, 0.4 s apart, with a pause after every 37."""
    w = split.select("video_id", F.posexplode("w").alias("pos", "text"))
    tenths = F.col("pos") * 4 + F.floor(F.col("pos") / 37) * 20
    return w.select("video_id", F.col("pos").cast("long").alias("pos"), "text", (tenths / 10).alias("start"), ((tenths + 3) / 10).alias("end"), (F.lit(1.0) / (F.col("pos") % 4 + 1)).alias("confidence"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_words(split_texts(spark, sf_dir))


WORDS_SQL = r"""words AS (
  SELECT video_id, pos, text, (pos * 4 + (pos // 37) * 20) / 10 AS start, (pos * 4 + (pos // 37) * 20 + 3) / 10 AS "end", 1.0::DOUBLE / (pos % 4 + 1) AS confidence
  FROM (SELECT concat('d', doc_id) AS video_id, unnest(w) AS text, unnest(range(len(w))) AS pos
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents) t) u)"""
