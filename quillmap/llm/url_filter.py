"""Urls judged by rules of hosts and paths, and else by the labelled purity of their path's template."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import stored

#: (verdict, host, start of the path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Levels of the tree; what lies deeper is one wildcard.
DEPTH = 5
#: A segment keeps its name where it has so many urls and at least such a part of its parent's, and becomes a wildcard elsewhere; a parent so has SHARE named branches at most.
LEAST, SHARE = 8, 32
#: Branches whose shares of good labels are less than so many standard errors apart are merged.
APART = 1.96
#: Labels that what stands above a branch counts as, and the share of good ones below which a template is rejected.
WEIGHT, PURE = 4.0, 0.5


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = out.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out.otherwise(None) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape_of(path: Column) -> Column:
    """The path's segments, empty ones left out, with each number as # and each long hexadecimal name as %; | is written %7C, as it joins the names of branches."""
    kind = lambda s: F.when(s.rlike("^[0-9A-Fa-f-]{16,}$"), F.lit("%")).otherwise(F.replace(F.regexp_replace(s, "[0-9]+", "#"), F.lit("|"), F.lit("%7C")))
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind), "/")


def smoothed(good: Column, bad: Column, above: Column) -> Column:
    return (good + above * WEIGHT) / (good + bad + WEIGHT)


def unlike(good: Column, bad: Column, good2: Column, bad2: Column) -> Column:
    """Whether two shares of good labels are APART standard errors apart; each side has one more label of both kinds."""
    n, n2 = good + bad + 2, good2 + bad2 + 2
    share = (good + good2 + 2) / (n + n2)
    return F.abs((good + 1) / n - (good2 + 1) / n2) >= APART * F.sqrt(share * (1 - share) * (1 / n + 1 / n2))


def template_tree(urls: DataFrame, labelled: DataFrame, steps: Steps) -> DataFrame:
    """urls: (host, shape); labelled: (host, shape, good). (host, shape, template, purity), a row for each shape of a host.

    Urls and labels are counted by host and shape first, so that a host of any size is a few rows
    from then on. The tree is then grown from each host's root, level by level: under every node, segments
    that are frequent there keep their name, all others are one wildcard, and branches that follow each other
    in the order of their smoothed purity are merged where their labels don't tell them apart. So nodes
    have SHARE branches and a wildcard at most. A node's purity is smoothed by its parent's, the root's by that of all labels.
    """
    counted = urls.groupBy("host", "shape").agg(F.count("*").alias("n"))
    marks = labelled.groupBy("host", "shape").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    none = F.lit(0).cast("long")
    level = counted.join(marks, ["host", "shape"], "left").withColumns({"good": F.coalesce("good", none), "bad": F.coalesce("bad", none)})
    level = steps.keep(level)
    total = level.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    prior = F.lit(((total["good"] or 0) + WEIGHT / 2) / ((total["good"] or 0) + (total["bad"] or 0) + WEIGHT))  # as much for as against without labels
    roots = level.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("host", smoothed(F.col("g"), F.col("b"), prior).alias("purity"))
    level = level.join(roots, "host").withColumn("node", F.lit(""))
    for depth in range(1, DEPTH + 1):
        parts = F.split("shape", "/")
        here = F.nullif(F.get(parts, F.lit(depth - 1)), F.lit(""))  # null behind the end of a path
        level = level.withColumn("segment", here if depth < DEPTH else F.when(F.size(parts) > DEPTH, F.lit("**")).otherwise(here))
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
        named = level.filter("segment IS NOT NULL").groupBy("host", "node", "segment").agg(*sums, F.first("purity").alias("above"))
        named = named.join(named.groupBy("host", "node").agg(F.sum("n").alias("of_node")), ["host", "node"])
        frequent = (F.col("n") >= LEAST) & (F.col("n") * SHARE >= F.col("of_node"))
        named = named.withColumn("branch", F.when(frequent | (F.col("segment") == "**"), F.col("segment")).otherwise("*"))
        branches = named.groupBy("host", "node", "branch").agg(*sums, F.first("above").alias("above"))
        order = Window.partitionBy("host", "node").orderBy("purity", "branch")  # SHARE + 2 branches at most
        before = lambda c: F.lag(c).over(order)
        cut = F.coalesce(unlike(F.col("good"), F.col("bad"), before("good"), before("bad")), F.lit(True))
        branches = branches.withColumn("purity", smoothed(F.col("good"), F.col("bad"), F.col("above"))).withColumn("cut", cut.cast("int"))
        branches = branches.withColumn("group", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        groups = branches.groupBy("host", "node", "group").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("above").alias("above"), F.array_sort(F.collect_list("branch")).alias("of"))
        groups = groups.select("host", "node", F.explode("of").alias("branch"), F.concat("node", F.lit("/"), F.array_join("of", "|")).alias("next"), smoothed(F.col("g"), F.col("b"), F.col("above")).alias("next_purity"))
        ways = named.select("host", "node", "segment", "branch").join(groups, ["host", "node", "branch"]).drop("branch")
        level = level.join(ways, ["host", "node", "segment"], "left")
        level = level.withColumns({"node": F.coalesce("next", "node"), "purity": F.coalesce("next_purity", "purity")}).drop("segment", "next", "next_purity")
        level = steps.keep(level)
    return level.select("host", "shape", F.col("node").alias("template"), "purity")


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity. labelled: (url, good), some urls with what is known of them.

    The longest rule whose host is the url's or a domain above it, and whose path begins the url's, gives
    the verdict. Without one the template of the url's path does: see template_tree(). It is blocked if
    the smoothed share of good labels is below PURE; so a host without any label goes by all labels,
    and without labels at all everything passes.

    Only urls are read. Hosts and shapes are partial aggregations, and rows find their shape's template by a
    join whose large side AQE can split, so a host may have any part of all rows.

    Defined cases: a null url, or one without ://, has an empty host and path and is judged with others of
    that kind; very long urls are read whole, levels from DEPTH on being one wildcard where a path goes deeper; a null
    page_id is a row like others, repeated rows give repeated rows, all of which count; labels with a null url or a null mark are
    left out; an empty table gives no rows; further columns are ignored.
    """
    parsed = lambda df, *more: df.select(*more, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = parsed(pages, F.col(id_col).alias("page_id")).withColumn("shape", shape_of(F.col("path")))
    known = labelled.filter("url IS NOT NULL AND good IS NOT NULL").select("good", host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"))
    with Steps(pages.sparkSession) as steps:
        tree = stored(template_tree(rows.select("host", "shape"), known, steps), "templates")
    judged = rows.join(tree, ["host", "shape"], "left").withColumn("told", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("purity") < PURE, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce("told.verdict", own).alias("verdict"), "template", "purity")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, good): urls whose path ends with the number of a labelled document; of several labels of one document the lowest counts."""
    number = F.nullif(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(\.html|/)?$", 1), F.lit("")).cast("long")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", (F.col("quality") == 1).alias("good"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, labelled_urls(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("purity")


def _sql() -> str:
    """The tree's levels one after the other, as SQL."""
    shape = "array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9A-Fa-f-]{16,}$') THEN '%' ELSE replace(regexp_replace(s, '[0-9]+', '#', 'g'), '|', '%7C') END), '/')"
    part = lambda k: f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
    smooth = lambda g, b, above: f"(({g} + {above} * {WEIGHT}::DOUBLE) / ({g} + {b} + {WEIGHT}::DOUBLE))"
    g, b, g2, b2 = "good", "bad", "lag(good) OVER w", "lag(bad) OVER w"
    share = f"(({g} + {g2} + 2) / ({g} + {b} + 2 + ({g2} + {b2} + 2)))"
    unlike_ = f"abs(({g} + 1) / ({g} + {b} + 2) - ({g2} + 1) / ({g2} + {b2} + 2)) >= {APART}::DOUBLE * sqrt({share} * (1 - {share}) * (1 / ({g} + {b} + 2) + 1 / ({g2} + {b2} + 2)))"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda of, rest: f"CASE {' '.join(f'WHEN {fits(h, p)} THEN {chr(39)}{of(v, h, p)}{chr(39)}' for v, h, p in ordered)} ELSE {rest} END"
    steps = [
        f"rows AS MATERIALIZED (SELECT page_id, host, path, {shape} AS shape FROM (SELECT page_id, translate({part(1)}, '{ascii_uppercase}', '{ascii_lowercase}') AS host, {part(2)} AS path FROM pages))",
        "marks AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id)",
        r"known AS (SELECT host, shape, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM (SELECT host, shape, try_cast(regexp_extract(path, '/([0-9]{1,18})(\.html|/)?$', 1) AS BIGINT) AS doc_id FROM rows) JOIN marks USING (doc_id) GROUP BY host, shape)",
        "l AS MATERIALIZED (SELECT host, shape, n, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM (SELECT host, shape, count(*) AS n FROM rows GROUP BY host, shape) LEFT JOIN known USING (host, shape))",
        f"prior AS (SELECT (coalesce(sum(good), 0) + {WEIGHT / 2}::DOUBLE) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + {WEIGHT}::DOUBLE) AS p FROM l)",
        f"l0 AS MATERIALIZED (SELECT *, {smooth('sum(good) OVER (PARTITION BY host)', 'sum(bad) OVER (PARTITION BY host)', '(SELECT p FROM prior)')} AS purity, '' AS node FROM l)",
    ]
    for d in range(1, DEPTH + 1):
        here = f"nullif(string_split(shape, '/')[{d}], '')"
        here = here if d < DEPTH else f"CASE WHEN len(string_split(shape, '/')) > {d} THEN '**' ELSE {here} END"
        steps += [
            f"t{d} AS MATERIALIZED (SELECT *, {here} AS segment FROM l{d - 1})",
            f"n{d} AS MATERIALIZED (SELECT *, CASE WHEN segment = '**' OR (n >= {LEAST} AND n * {SHARE} >= sum(n) OVER (PARTITION BY host, node)) THEN segment ELSE '*' END AS branch FROM (SELECT host, node, segment, sum(n) AS n, sum(good) AS good, sum(bad) AS bad, any_value(purity) AS above FROM t{d} WHERE segment IS NOT NULL GROUP BY host, node, segment))",
            f"b{d} AS (SELECT *, {smooth(g, b, 'above')} AS purity FROM (SELECT host, node, branch, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad, any_value(above) AS above FROM n{d} GROUP BY host, node, branch))",
            f"c{d} AS (SELECT *, coalesce({unlike_}, true)::INT AS cut FROM b{d} WINDOW w AS (PARTITION BY host, node ORDER BY purity, branch))",
            f"g{d} AS (SELECT *, sum(cut) OVER (PARTITION BY host, node ORDER BY purity, branch ROWS UNBOUNDED PRECEDING) AS grp FROM c{d})",
            f"m{d} AS (SELECT host, node, list_sort(list(branch)) AS of, {smooth('sum(good)', 'sum(bad)', 'any_value(above)')} AS next_purity FROM g{d} GROUP BY host, node, grp)",
            f"w{d} AS (SELECT n.host, n.node, n.segment, concat(n.node, '/', array_to_string(of, '|')) AS next, next_purity FROM n{d} n JOIN m{d} m ON n.host = m.host AND n.node = m.node AND list_contains(m.of, n.branch))",
            f"l{d} AS MATERIALIZED (SELECT t.host, t.shape, t.n, t.good, t.bad, coalesce(next_purity, purity) AS purity, coalesce(next, t.node) AS node FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND t.node = w.node AND t.segment = w.segment)",
        ]
    return f"""WITH {", ".join(steps)}
SELECT page_id, host, path, {case(lambda v, h, p: h + p, 'NULL')} AS rule, {case(lambda v, h, p: v, f"CASE WHEN purity < {PURE} THEN 'block' ELSE 'allow' END")} AS verdict, node AS template
FROM rows JOIN l{DEPTH} USING (host, shape)"""


SQL = _sql()
