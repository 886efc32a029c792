import random

from pyspark.sql import functions as F

from quillmap.functions.text import normalize_name
from quillmap.operators import knowledge
from quillmap.schemas import MENTIONS, RELATIONSHIPS

from .test_operators import mentions_of, relations_of, rows


def plain_registry(units, norm):
    """units: for each unit the mentions (name, aliases, type, definition). What each unit's mentions become, entry by entry and scanning all of them."""
    entries = []
    for unit in units:
        for name, aliases, kind, definition in unit:
            key, others = norm[name], [norm[a] for a in aliases or []]
            at = next((e for e in entries if e["key"] == key), None)
            if at is None:
                at = next((e for a in others for e in entries if e["key"] == a), None)
            if at is None:
                at = next((e for e in entries if {key, *others} & e["keys"]), None)
            if at is None:
                at = {"key": key, "name": name, "type": kind, "keys": set(), "called": set(), "definitions": []}
                entries.append(at)
            at["keys"] |= {key, *others}
            at["called"] |= {name, *(aliases or [])}
            at["definitions"].append(definition)
    stands = {}
    for e in entries:
        for called in e["called"]:
            stands[norm[called]] = e
    out = []
    for u, unit in enumerate(units):
        seen = set()
        for pos, (name, *_) in enumerate(unit):
            e = stands[norm[name]]
            if e["name"] in seen:
                continue
            seen.add(e["name"])
            fits = [d for d in e["definitions"] if 0 < len(d) < 500]
            best = max(fits, key=len) if fits else e["definitions"][0]
            out.append((u, pos, e["name"], sorted(e["called"] - {e["name"]}), e["type"], best))
    return out


def told(kept):
    return rows(kept.select("seg_no", "pos", "name", "aliases", "type", "definition"), "seg_no", "pos")


def test_a_name_stands_for_the_last_entry_that_holds_it(spark):
    m = mentions_of(spark, [("X", ["Y"], "", "core"), ("Z", ["W"], "", "core")], [("Z", ["X"], "", "core"), ("X", [], "", "core")])
    kept, left = knowledge.deduplicate(m, relations_of(spark, ("X", "W", "extends"), ("Y", "X", "extends")))
    assert [(x[0], x[1], x[2], x[3]) for x in told(kept)] == [(0, 0, "Z", ["W", "X"]), (1, 0, "Z", ["W", "X"])]
    assert rows(left.select("from_concept", "to_concept"), "pos") == [("Z", "Z"), ("X", "Z")]


def test_crossing_aliases_agree_with_a_loop(spark):
    r = random.Random(7)
    names = [f"{w}{e}" for w in ("graph", "Graph", "node-", "edge_", "tree", "box", "leaf", "root", "path", "set") for e in ("", "s", " two")]
    norm = {x.name: x.key for x in spark.createDataFrame([(n,) for n in names], "name string").select("name", normalize_name(F.col("name")).alias("key")).collect()}
    made, want = [], {}
    for v in range(40):
        units = [[(r.choice(names), r.choice([None, *[r.sample(names, r.randint(0, 3)) for _ in range(4)]]), r.choice(["model", "metric"]), "d" * r.choice([0, 3, 9, 600])) for _ in range(r.randint(0, 6))] for _ in range(r.randint(1, 6))]
        made += [(f"v{v}", u, f"s{u}", p, n, a, t, d, "core", None) for u, unit in enumerate(units) for p, (n, a, t, d) in enumerate(unit)]
        want[f"v{v}"] = plain_registry(units, norm)
    kept, _ = knowledge.deduplicate(spark.createDataFrame(made, MENTIONS).repartition(5), spark.createDataFrame([], RELATIONSHIPS))
    kept = kept.select("video_id", "seg_no", "pos", "name", "aliases", "type", "definition").collect()
    assert {v: sorted(tuple(x)[1:] for x in kept if x.video_id == v) for v in want} == want


def test_the_registry_is_folded_once(spark):
    """Both results read what the fold wrote."""
    m = mentions_of(spark, [("A", ["B"], "", "core")])
    for df in knowledge.deduplicate(m, relations_of(spark, ("A", "B", "extends"))):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_entries_cost_no_scan_of_all(spark):
    m = spark.range(30_000).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("seg_no"), F.lit("s").alias("segment_id"), F.lit(0).alias("pos"), F.concat(F.lit("concept "), "id").alias("name"), F.array(F.concat(F.lit("other "), "id")).alias("aliases"), F.lit("model").alias("type"), F.lit("d").alias("definition"))
    assert knowledge.registry(m).agg(F.max("entry")).first()[0] == 29_999


def test_nulls_and_no_rows(spark):
    m = mentions_of(spark, [("A", None, None, "core"), ("a", [None, "B"], "d", "core")])
    assert told(knowledge.deduplicate(m, relations_of(spark))[0]) == [(0, 0, "A", ["B", "a"], "definition", "d")]
    assert knowledge.deduplicate(m.limit(0), relations_of(spark))[0].isEmpty()


def test_unique_concepts_arent_their_own_aliases(spark):
    m = mentions_of(spark, [("B", ["B", "y"], "d", "mentioned")])
    assert rows(knowledge.unique_concepts(m).select("name", "aliases")) == [("B", ["y"])]
