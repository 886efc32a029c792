"""DuckDB SQL for the registered queries; folds and loops are recursive CTEs."""

from __future__ import annotations

from ..functions.text import NOISE, TYPE_ALIASES, VALID_TYPES
from .corpus import WORDS_SQL, ctes


def norm(x: str) -> str:
    return f"""(SELECT CASE WHEN n LIKE '%ies' AND length(n) > 4 THEN concat(substring(n, 1, length(n) - 3), 'y')
        WHEN regexp_matches(n, '(s|x|z|ch|sh)es$') AND length(n) > 4 THEN substring(n, 1, length(n) - 2)
        WHEN n LIKE '%es' AND length(n) > 4 THEN substring(n, 1, length(n) - 2)
        WHEN n LIKE '%s' AND length(n) > 3 AND n NOT LIKE '%ss' AND NOT regexp_matches(n, '[aeiou]s$') THEN substring(n, 1, length(n) - 1) ELSE n END
        FROM (SELECT trim(regexp_replace(regexp_replace(lower({x}), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS n))"""


PART_NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') ELSE concat(p_name, 'es') END"
RANK = "CASE importance WHEN 'core' THEN 3 WHEN 'supporting' THEN 2 WHEN 'mentioned' THEN 1 ELSE 0 END"
#: Of a group's definitions in the order of {o}.
BEST_DEF = "coalesce((list(definition ORDER BY length(definition) DESC, {o}) FILTER (length(definition) > 0 AND length(definition) < 500))[1], (list(definition ORDER BY {o}))[1], '')"
BEST_IMP = f"(list(importance ORDER BY {RANK} DESC, {{o}}))[1]"
WORDS_OF = "list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
TURNED = f"""(type = 'is_part_of' AND ((len(list_filter({WORDS_OF.format(x="from_concept")}, lambda f: len(list_filter({WORDS_OF.format(x="to_concept")}, lambda t: starts_with(f, substring(t, 1, 4)) OR starts_with(t, substring(f, 1, 4)))) > 0)) > 0
    AND length(from_concept) > length(to_concept)) OR contains(lower(from_concept), lower(to_concept))))"""
COSINE = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
HITS = f"""hits AS (SELECT concat('s', vec_id) AS segment_id, concat('v', label) AS video_id, concat('text of ', vec_id) AS document,
    greatest(0.0, {COSINE.format(a="embedding", b="(SELECT embedding FROM embeddings WHERE vec_id = 0)")}) AS score FROM embeddings"""
#: Vectors drawn towards the axis of their label, and of the label `turn` farther on.
TOPICS = "SELECT vec_id AS id, label, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = (label + {turn}) % 10 THEN 2.0 ELSE 0.0 END) AS v FROM embeddings"
INDEXED = "WITH topics AS ({t}), q AS (SELECT v AS w FROM ({q}) WHERE id = 0) SELECT id, label, round(greatest(0.0, list_cosine_similarity(v, w)), 6) AS score FROM topics, q {where} ORDER BY greatest(0.0, list_cosine_similarity(v, w)) DESC, id LIMIT {k}"
CURVE = f"""curve AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY video_id) > 3 THEN (coalesce(lag(sim) OVER w, sim) + sim + coalesce(lead(sim) OVER w, sim)) / 3 ELSE sim END AS smoothed FROM (
    SELECT video_id, sent_idx AS idx, {COSINE.format(a="embedding", b="lead(embedding) OVER (PARTITION BY video_id ORDER BY sent_idx)")} AS sim FROM sentence_vectors) s WHERE sim IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY idx))"""
DEPTH = """deep AS (SELECT *, (max(smoothed) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) - smoothed + max(smoothed) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) - smoothed) / 2 AS depth FROM curve)"""
MINIMA = """low AS (SELECT * FROM (SELECT *, sum(is_low::INT) OVER (PARTITION BY video_id) AS lows, row_number() OVER (PARTITION BY video_id ORDER BY smoothed, idx) AS nth FROM (
    SELECT *, coalesce(smoothed < lag(smoothed) OVER w AND smoothed < lead(smoothed) OVER w, false) AS is_low FROM deep WINDOW w AS (PARTITION BY video_id ORDER BY idx)) a) b WHERE is_low OR (lows = 0 AND nth = 1))"""
GREEDY = """cand AS (SELECT l.video_id, l.idx, s.t0 AS t, row_number() OVER (PARTITION BY l.video_id ORDER BY depth DESC, l.idx) AS k FROM low l JOIN sentences s ON s.video_id = l.video_id AND s.sent_idx = l.idx + 1),
fold AS (
    SELECT video_id, 0::BIGINT AS k, [0.0::DOUBLE] AS times, []::BIGINT[] AS taken FROM cand GROUP BY video_id
    UNION ALL
    SELECT f.video_id, c.k, CASE WHEN free THEN list_append(times, c.t) ELSE times END, CASE WHEN free THEN list_append(taken, c.idx) ELSE taken END
    FROM fold f JOIN cand c ON c.video_id = f.video_id AND c.k = f.k + 1, LATERAL (SELECT len(list_filter(f.times, lambda x: abs(x - c.t) < 65.0)) = 0 AS free) z)"""
#: The whole-table boundary rule of the segment queries: every sentence with sent_idx % 13 = 5 ends a segment.
SPLIT = """pts AS (SELECT video_id, sent_idx + 1 AS p FROM sentences WHERE sent_idx % 13 = 5 UNION SELECT video_id, 0 FROM sentences UNION SELECT video_id, count(*) FROM sentences GROUP BY video_id),
gaps AS (SELECT * FROM (SELECT video_id, p, lead(p) OVER (PARTITION BY video_id ORDER BY p) AS q FROM pts) g WHERE q > p)"""
#: All boundaries of the segmentation: the greedy ones and one in the middle of every stretch above 300 s.
CUTS = """greedy AS (SELECT video_id, unnest(taken) AS idx FROM (SELECT video_id, arg_max(taken, k) AS taken FROM fold GROUP BY video_id) f),
pts AS (SELECT video_id, idx + 1 AS p FROM greedy UNION SELECT video_id, 0 FROM sentences UNION SELECT video_id, count(*) FROM sentences GROUP BY video_id),
gaps AS (SELECT * FROM (SELECT video_id, p, lead(p) OVER (PARTITION BY video_id ORDER BY p) AS q FROM pts) g WHERE q > p),
cuts AS (SELECT video_id, idx FROM greedy UNION SELECT g.video_id, (p + q) // 2 - 1 FROM gaps g JOIN sentences a ON a.video_id = g.video_id AND a.sent_idx = p JOIN sentences b ON b.video_id = g.video_id AND b.sent_idx = q - 1 WHERE b.t1 - a.t0 > 300.0 AND (p + q) // 2 > p),
grp AS (SELECT *, coalesce(sum(mark) OVER (PARTITION BY video_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT + 1 AS seg_no FROM (SELECT s.*, (c.idx IS NOT NULL)::INT AS mark FROM sentences s LEFT JOIN cuts c ON c.video_id = s.video_id AND c.idx = s.sent_idx) z)"""


def merged(min_s: float) -> str:
    """Segments of the numbered sentences grp, and the first short one after the other joined to a neighbour."""
    return f"""segs AS MATERIALIZED (SELECT video_id, seg_no, arg_min(t0, sent_idx) AS s, arg_max(t1, sent_idx) AS e, string_agg(text, ' ' ORDER BY sent_idx) AS transcript, count(*) AS n,
    CASE WHEN count(*) OVER (PARTITION BY video_id) = 1 THEN 'Full transcript' ELSE concat('Segment ', seg_no) END AS title FROM grp GROUP BY video_id, seg_no),
joined AS (
    SELECT video_id, 0 AS k, list({{'s': s, 'e': e, 'a': seg_no, 'b': seg_no}} ORDER BY seg_no) AS g FROM segs GROUP BY video_id
    UNION ALL
    SELECT video_id, k + 1, list_concat(list_concat(g[:a - 1], [{{'s': g[a].s, 'e': g[a + 1].e, 'a': g[a].a, 'b': g[a + 1].b}}]), g[a + 2:])
    FROM (SELECT *, CASE WHEN i = len(g) THEN i - 1 WHEN i = 1 THEN 1 WHEN g[i - 1].e - g[i - 1].s <= g[i + 1].e - g[i + 1].s THEN i - 1 ELSE i END AS a
          FROM (SELECT *, list_position(list_transform(g, lambda x: x.e - x.s < {min_s}), true) AS i FROM joined WHERE len(g) > 1) x WHERE i > 0) y),
pieces AS (SELECT video_id, unnest(range(1, len(g) + 1))::INT AS seg_no, unnest(g) AS p FROM (SELECT video_id, arg_max(g, k) AS g FROM joined GROUP BY video_id))
SELECT format('{{}}_seg{{:03d}}', p.video_id, p.seg_no) AS segment_id, p.video_id, p.seg_no, arg_min(title, x.seg_no) AS title, any_value(p.p.s) AS start_s, any_value(p.p.e) AS end_s, string_agg(transcript, ' ' ORDER BY x.seg_no) AS transcript, sum(n)::INT AS n_sentences
FROM pieces p JOIN segs x ON x.video_id = p.video_id AND x.seg_no BETWEEN p.p.a AND p.p.b GROUP BY p.video_id, p.seg_no"""


ALIASES = "array_to_string({x}, '|')"
REGISTERED = f"""ids AS (SELECT p_partkey AS idx, {PART_NAME} AS name, p_brand AS alias, p_type AS type, concat(p_brand, ' ', repeat('x', cast(p_partkey % 5 AS INT))) AS definition,
    CASE WHEN p_size < 17 THEN 'core' WHEN p_size < 34 THEN 'supporting' ELSE 'mentioned' END AS importance FROM part),
keyed AS (SELECT *, {norm("name")} AS key FROM ids),
grouped AS (SELECT *, min(idx) OVER (PARTITION BY key) AS component FROM keyed)"""
MERGED = f"""m0 AS (SELECT component, (list(name ORDER BY idx))[1] AS name, list_distinct(list_concat(list(name), list(alias))) AS names, (list(type ORDER BY idx))[1] AS type, {BEST_DEF.format(o="idx")} AS definition,
    {BEST_IMP.format(o="idx")} AS importance, count(*) AS members FROM grouped GROUP BY component),
merged AS (SELECT component AS idx, name, list_sort(list_filter(names, lambda x: x <> name)) AS aliases, type, definition, importance, members FROM m0)"""
KNOWN = "known AS (SELECT DISTINCT name FROM mentions WHERE name NOT LIKE 'old%')"
EDGES = """made AS (SELECT src, dst, type, (list(evidence ORDER BY video_id DESC))[1] AS evidence, max(video_id) AS video_id FROM (
    SELECT from_concept AS src, to_concept AS dst, upper(type) AS type, video_id, (list(evidence ORDER BY seg_no, pos))[1] AS evidence FROM relationships
    WHERE from_concept IN (SELECT name FROM known) AND to_concept IN (SELECT name FROM known) GROUP BY ALL) e GROUP BY src, dst, type)"""
PLACES = """places AS (SELECT concept AS name, segment_id, s.video_id, t0, t1 FROM (SELECT DISTINCT concept, segment_id FROM explained_in) e JOIN segments s USING (segment_id) JOIN videos v ON v.video_id = s.video_id),
first_place AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t0, segment_id) AS nth FROM places) p WHERE nth = 1)"""
DEPENDS = "dep AS (SELECT src, dst FROM concept_edges WHERE type = 'DEPENDS_ON')"


#: The registry, mention by mention: each row has the entries so far, with the key that opened each and the keys it holds.
REGISTRY = f"""m AS MATERIALIZED (SELECT * EXCLUDE (alias1, alias2), list_filter([alias1, alias2], lambda a: a IS NOT NULL) AS aliases, {norm("name")} AS key, list_filter([{norm("alias1")}, {norm("alias2")}], lambda a: a IS NOT NULL) AS aks,
    row_number() OVER (PARTITION BY video_id ORDER BY seg_no, pos) AS k FROM crossing),
fold AS (
    SELECT video_id, 0::BIGINT AS k, []::STRUCT(key VARCHAR, ks VARCHAR[])[] AS entries, 0::BIGINT AS entry FROM m GROUP BY video_id
    UNION ALL
    SELECT f.video_id, m.k, CASE WHEN z.entry > len(f.entries) THEN list_append(f.entries, {{'key': m.key, 'ks': list_append(m.aks, m.key)}})
           ELSE list_transform(f.entries, lambda e, i: CASE WHEN i = z.entry THEN {{'key': e.key, 'ks': list_distinct(list_concat(e.ks, m.aks, [m.key]))}} ELSE e END) END, z.entry
    FROM fold f JOIN m ON m.video_id = f.video_id AND m.k = f.k + 1, LATERAL (SELECT list_transform(f.entries, lambda e: e.key) AS opened) o,
         LATERAL (SELECT coalesce(nullif(list_position(opened, m.key), 0), list_filter(list_transform(m.aks, lambda a: list_position(opened, a)), lambda x: x > 0)[1],
                                  nullif(list_position(list_transform(f.entries, lambda e: list_has_any(e.ks, list_append(m.aks, m.key))), true), 0), len(f.entries) + 1)::BIGINT AS entry) z),
e AS MATERIALIZED (SELECT m.*, entry FROM m JOIN fold USING (video_id, k)),
canon AS MATERIALIZED (SELECT video_id, entry, (list(name ORDER BY k))[1] AS cname, list_distinct(flatten(list(list_append(aliases, name)))) AS names, (list(type ORDER BY k))[1] AS ctype, {BEST_DEF.format(o="k")} AS cdef FROM e GROUP BY video_id, entry),
nm AS MATERIALIZED (SELECT video_id, key, entry, cname, list_sort(list_filter(names, lambda x: x <> cname)) AS caliases, ctype, cdef FROM (SELECT video_id, key, max(entry) AS entry FROM (SELECT video_id, entry, unnest(list_append(aks, key)) AS key FROM e) GROUP BY video_id, key) JOIN canon USING (video_id, entry))"""


#: Attempts to calls and segments.
CALLS = r"""tried AS (SELECT *, error IS NOT NULL AND contains(error, '429') AND NOT contains(error, 'insufficient_quota') AS again,
    least(coalesce(try_cast(nullif(regexp_extract(lower(error), 'retry after ([\d.]+)', 1), '') AS DOUBLE) + 2, 15.0), 30.0) AS delay FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id, kind ORDER BY attempt) AS t FROM attempts) x WHERE t <= 3),
ends AS (SELECT video_id, segment_id, kind, count(*) AS seen, min(t) FILTER (NOT again) AS hit, max(t) AS latest FROM tried GROUP BY ALL),
judged AS (SELECT e.*, x.error AS end_error, x.body, l.error AS last_error, CASE WHEN hit IS NULL THEN CASE WHEN seen < 3 THEN 'pending' ELSE 'exhausted' END WHEN contains(x.error, 'insufficient_quota') THEN 'quota' WHEN x.error IS NOT NULL THEN 'error'
        WHEN json_valid(x.body) AND json_type(CASE WHEN json_valid(x.body) THEN x.body END) = CASE e.kind WHEN 'metadata' THEN 'OBJECT' ELSE 'ARRAY' END THEN 'answered' ELSE 'error' END AS outcome
    FROM ends e LEFT JOIN tried x ON x.video_id = e.video_id AND x.segment_id = e.segment_id AND x.kind = e.kind AND x.t = e.hit JOIN tried l ON l.video_id = e.video_id AND l.segment_id = e.segment_id AND l.kind = e.kind AND l.t = e.latest),
waits AS (SELECT e.video_id, e.segment_id, e.kind, coalesce(sum(delay) FILTER (again AND (hit IS NULL OR t < hit)), 0.0) AS waited FROM ends e JOIN tried USING (video_id, segment_id, kind) GROUP BY ALL),
calls AS MATERIALIZED (SELECT video_id, segment_id, kind, outcome, coalesce(hit, seen)::INT AS tries, waited, CASE WHEN outcome = 'answered' THEN body END AS body,
    CASE WHEN hit IS NULL THEN last_error ELSE coalesce(end_error, CASE WHEN outcome = 'error' THEN 'not an answer of its kind' END) END AS error FROM judged JOIN waits USING (video_id, segment_id, kind)),
wide AS (SELECT s.video_id, s.seg_no, s.segment_id, coalesce(m.outcome, 'pending') AS m, m.error AS me, coalesce(c.outcome, 'pending') AS c, c.error AS ce, c.body, coalesce(r.outcome, 'pending') AS r, r.error AS re
    FROM segments s LEFT JOIN calls m ON m.segment_id = s.segment_id AND m.kind = 'metadata' LEFT JOIN calls c ON c.segment_id = s.segment_id AND c.kind = 'concepts' LEFT JOIN calls r ON r.segment_id = s.segment_id AND r.kind = 'relationships'),
own AS (SELECT video_id, seg_no, segment_id, CASE WHEN m <> 'answered' THEN m WHEN c <> 'answered' THEN c WHEN r <> 'answered' AND json_array_length(body) > 0 THEN r ELSE 'done' END AS outcome,
    CASE WHEN m <> 'answered' THEN me WHEN c <> 'answered' THEN ce WHEN r <> 'answered' AND json_array_length(body) > 0 THEN re END AS reason FROM wide),
outcomes AS MATERIALIZED (SELECT video_id, seg_no, segment_id, CASE WHEN late THEN 'cancelled' ELSE outcome END AS outcome, CASE WHEN NOT late THEN reason END AS reason
    FROM (SELECT *, coalesce(seg_no > min(seg_no) FILTER (outcome = 'quota') OVER (PARTITION BY video_id), false) AS late FROM own) o),
summary AS (SELECT * FROM (SELECT video_id, count(*) AS segments, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome IN ('error', 'exhausted', 'quota')) AS failed, count(*) FILTER (outcome = 'cancelled') AS cancelled,
    count(*) FILTER (outcome = 'pending') AS pending FROM outcomes GROUP BY video_id) o LEFT JOIN (SELECT video_id, sum(tries)::BIGINT AS tries, sum(waited) AS waited FROM calls GROUP BY video_id) c USING (video_id)),
batch AS (SELECT substring(v.video_id, 2)::BIGINT AS ordinal, v.video_id, CASE WHEN done = 0 THEN concat(failed, ' of ', segments) END AS error FROM videos v LEFT JOIN summary s ON s.video_id = v.video_id)"""

CALLS_ONLY = CALLS[: CALLS.index(",\nwide AS")]


#: The elements of each response that is a list, with their places.
ANSWERED = "answered AS (SELECT video_id, segment_id, kind, unnest(range(len(a))) AS pos, unnest(a) AS c FROM (SELECT *, body::JSON::JSON[] AS a FROM responses WHERE kind <> 'metadata') r)"


def reach(most: int, edges: str = "dep", back: int = 1, first: int = 1) -> str:
    goal = f"(SELECT name FROM concepts WHERE id = (SELECT count(*) - {back} FROM part))"
    start = f"SELECT dst AS name, 1 AS depth FROM {edges} WHERE src = {goal}" if first else f"SELECT {goal} AS name, 0 AS depth"
    return f"walk AS ({start} UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.name WHERE w.depth < {most}), near AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name)"


PATH = f"""{DEPENDS}, {PLACES}, {reach(10, first=0)},
knows AS (SELECT name FROM concepts WHERE id IN (0, 1, 3)), todo AS (SELECT name FROM near WHERE name NOT IN (SELECT name FROM knows)),
sub AS (SELECT DISTINCT src, dst FROM dep WHERE src IN (SELECT name FROM todo) AND dst IN (SELECT name FROM todo)),
climb AS (SELECT name, 0 AS level FROM todo WHERE name NOT IN (SELECT src FROM sub) UNION SELECT s.src, c.level + 1 FROM climb c JOIN sub s ON s.dst = c.name),
levels AS (SELECT name, max(level) AS level FROM climb GROUP BY name),
steps AS (SELECT l.name, level, row_number() OVER (ORDER BY level, l.name) AS position, segment_id, coalesce(t1 - t0, 0.0) AS seconds FROM levels l LEFT JOIN first_place p ON p.name = l.name)"""


def _with(views: str, *more: str) -> str:
    head = ctes(*views.split()) if views else "WITH RECURSIVE "
    return head + (", " if views and more else "") + ", ".join(more)


def oracle_sql() -> dict[str, str]:
    in_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
    mapped = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_ALIASES.items())
    noisy = "(" + " OR ".join(f"contains(t, '{k}')" for k in NOISE) + ")"
    noise = f"noisy AS (SELECT DISTINCT video_id, seg_no, name FROM (SELECT *, concat(lower(name), ' ', lower(definition)) AS t FROM mentions) x WHERE {noisy})"
    hour = "(event_id * 7 + value)"
    h, m, s = f"floor({hour})::BIGINT // 3600", f"floor({hour})::BIGINT % 3600 // 60", f"floor({hour})::BIGINT % 60"
    message = "concat(CASE event_id % 3 WHEN 0 THEN '429 Retry after ' WHEN 1 THEN '500 error ' ELSE '429 insufficient_quota ' END, user_id, 's')"
    group = "grp AS (SELECT *, coalesce(sum(mark) OVER (PARTITION BY video_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT + 1 AS seg_no FROM (SELECT *, (sent_idx % 13 = 5)::INT AS mark FROM sentences) z)"
    sources = "made AS (SELECT source FROM videos UNION ALL SELECT concat('https://youtu.be/', video_id) FROM videos UNION ALL SELECT url FROM pages)"
    suffix = "lower(regexp_extract(source, '[^/](\\.[^./]+)$', 1))"
    kind = f"CASE WHEN regexp_matches(source, '^(https?://)?(www\\.)?(youtube\\.com/(watch\\?v=|embed/)|youtu\\.be/)') THEN 'url' WHEN {suffix} IN ('.wav', '.mp3', '.m4a', '.flac', '.ogg') THEN 'audio' WHEN {suffix} <> '' THEN 'video' ELSE 'missing' END"
    body = """concat('[{"name":"', p_name, '"', CASE WHEN p_partkey % 2 = 0 THEN concat(',"type":"', p_type, '","aliases":["', p_brand, '"]') ELSE '' END, '},{"name":"other","importance":"core"}]')"""
    vec = "SELECT segment_id, video_id, round(score, 6) AS score FROM hits {w} ORDER BY hits.score DESC, segment_id LIMIT 10"
    found = {
        "vec_topk": f"WITH {HITS}) " + vec.format(w=""),
        "vec_topk_filtered": f"WITH {HITS}) " + vec.format(w="WHERE video_id = 'v3'"),
        "search_enriched": _with("explained_in concept_edges illustrates examples", HITS + ")", "top AS (SELECT * FROM hits ORDER BY score DESC, segment_id LIMIT 10)", "here AS (SELECT DISTINCT segment_id, concept FROM explained_in WHERE segment_id IN (SELECT segment_id FROM top))") + """
            SELECT segment_id, round(score, 6) AS score, document AS excerpt,
                coalesce((SELECT string_agg(concept, '|' ORDER BY concept) FROM here h WHERE h.segment_id = t.segment_id), '') AS concepts,
                coalesce((SELECT string_agg(DISTINCT dst, '|' ORDER BY dst) FROM here h JOIN concept_edges e ON e.src = h.concept WHERE h.segment_id = t.segment_id AND type = 'DEPENDS_ON'), '') AS prerequisites,
                coalesce((SELECT string_agg(DISTINCT dst, '|' ORDER BY dst) FROM here h JOIN concept_edges e ON e.src = h.concept WHERE h.segment_id = t.segment_id AND type NOT IN ('DEPENDS_ON', 'EXPLAINED_IN')), '') AS related,
                coalesce((SELECT string_agg(DISTINCT description, '|' ORDER BY description) FROM here h JOIN illustrates i ON i.concept = h.concept JOIN examples x ON x.example_id = i.example_id WHERE h.segment_id = t.segment_id), '') AS examples
            FROM top t""",
        "index_segments": """SELECT concat('s', vec_id) AS id, concat('s', vec_id) AS segment_id, concat('v', label) AS video_id, concat('text of ', vec_id) AS document, 'new' AS title, len(embedding) AS dims FROM embeddings
            UNION ALL SELECT concat('s', vec_id, 'x'), concat('s', vec_id, 'x'), concat('v', label), 'before', 'old', len(embedding) FROM embeddings WHERE vec_id % 3 = 0""",
        "index_concepts": f"""WITH c AS (SELECT {PART_NAME} AS name, max(concat(p_brand, ' ', p_type)) AS definition, max(p_brand) AS brand FROM part GROUP BY 1), k AS (SELECT *, concat('concept_', {norm("name")}) AS id FROM c)
            SELECT id, concat(name, ': ', definition) AS document, name, concat('["', brand, '"]') AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name DESC) AS nth FROM k) z WHERE nth = 1""",
        "candidate_pairs": f"SELECT * FROM (SELECT a.vec_id AS idx_a, b.vec_id AS idx_b, {COSINE.format(a='a.embedding', b='b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) p WHERE sim >= 0.4".replace("SELECT * FROM", "SELECT idx_a, idx_b, round(sim, 4) AS sim FROM", 1),
        "consecutive_cosine": _with("sentence_vectors", CURVE) + " SELECT video_id, idx, round(sim, 6) AS sim FROM curve",
        "smoothed_similarity": _with("sentence_vectors", CURVE) + " SELECT video_id, idx, round(smoothed, 6) AS smoothed FROM curve",
        "depth_score": _with("sentence_vectors", CURVE, DEPTH) + " SELECT video_id, idx, round(depth, 6) AS depth FROM deep",
        "local_minima": _with("sentence_vectors", CURVE, DEPTH, MINIMA) + " SELECT video_id, idx, round(smoothed, 6) AS smoothed FROM low",
        "boundary_greedy": _with("sentences", CURVE, DEPTH, MINIMA, GREEDY) + " SELECT video_id, unnest(taken) AS idx FROM (SELECT video_id, arg_max(taken, k) AS taken FROM fold GROUP BY video_id) f",
        "max_split": _with("sentences", SPLIT) + """ SELECT video_id, sent_idx AS idx FROM sentences WHERE sent_idx % 13 = 5 UNION
            SELECT g.video_id, (p + q) // 2 - 1 FROM gaps g JOIN sentences a ON a.video_id = g.video_id AND a.sent_idx = p JOIN sentences b ON b.video_id = g.video_id AND b.sent_idx = q - 1 WHERE b.t1 - a.t0 > 200.0 AND (p + q) // 2 > p""",
        "segment_build": _with("sentences", group) + """ SELECT format('{}_seg{:03d}', video_id, seg_no) AS segment_id, video_id, seg_no, CASE WHEN (SELECT count(*) FROM grp x WHERE x.video_id = grp.video_id) <= 1 THEN 'Full transcript' ELSE concat('Segment ', seg_no) END AS title,
            arg_min(t0, sent_idx) AS start_s, arg_max(t1, sent_idx) AS end_s, string_agg(text, ' ' ORDER BY sent_idx) AS transcript, count(*)::INT AS n_sentences FROM grp GROUP BY video_id, seg_no""",
        "merge_short": _with("sentences", group + ", " + merged(250.0)),
        "segment_pipeline": _with("sentences", CURVE, DEPTH, MINIMA, GREEDY.replace("65.0", "60.0"), CUTS + ", " + merged(60.0)),
        "sentence_grouping": "WITH " + WORDS_SQL + r""", w AS (SELECT *, round("end", 3) AS e, round(start, 3) AS s FROM words),
            b AS (SELECT *, (right(text, 1) IN ('.', '?', '!', '。', '？', '！') OR coalesce(lead(s) OVER (PARTITION BY video_id ORDER BY pos) - e > 1.0, false))::INT AS brk FROM w),
            r AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM b),
            p AS (SELECT *, (row_number() OVER (PARTITION BY video_id, run ORDER BY pos) - 1) // 50 AS part FROM r)
            SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY min(pos)) - 1 AS sent_idx, string_agg(text, ' ' ORDER BY pos) AS text, round(arg_min(s, pos), 3) AS start_s, round(arg_max(e, pos), 3) AS end_s, round(avg(round(confidence, 3)), 3) AS confidence
            FROM p GROUP BY video_id, run, part""",
        "normalize_name": f"SELECT p_partkey, {norm(PART_NAME)} AS name FROM part",
        "normalize_type": _with("mentions") + f" SELECT CASE WHEN k IN ({in_list(VALID_TYPES)}) THEN k ELSE CASE k {mapped} ELSE 'definition' END END AS type, count(*) AS n FROM (SELECT trim(lower(type)) AS k FROM mentions) m GROUP BY 1",
        "noise_filter": _with("relationships", noise) + """ SELECT segment_id, pos, 'mention' AS kind, name FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.video_id = m.video_id AND n.seg_no = m.seg_no AND n.name = m.name)
            UNION ALL SELECT segment_id, pos, 'relationship', concat(from_concept, '>', to_concept) FROM relationships m WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.video_id = m.video_id AND n.seg_no = m.seg_no AND n.name IN (m.from_concept, m.to_concept))""",
        "best_definition_query": _with("mentions") + f" SELECT segment_id, {BEST_DEF.format(o='pos')} AS definition FROM mentions GROUP BY segment_id",
        "best_importance_query": _with("mentions") + f" SELECT segment_id, {BEST_IMP.format(o='pos')} AS importance FROM mentions GROUP BY segment_id",
        "fix_direction": _with("relationships") + f" SELECT segment_id, pos, {TURNED} AS turned FROM relationships",
        "source_dispatch": _with("videos", sources) + f" SELECT source, concat('vid_', substring(md5(source), 1, 8)) AS video_id, {kind} AS kind, CASE WHEN {kind} IN ('audio', 'video') THEN regexp_replace(regexp_extract(source, '([^/]+)$', 1), '\\.[^.]*$', '') END AS title FROM made",
        "source_list": "SELECT url AS source FROM pages WHERE page_id % 5 > 1",
        "format_timestamp": f"SELECT event_id, CASE WHEN {h} > 0 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', {h}, {m}, {s}) ELSE format('{{:02d}}:{{:02d}}', {m}, {s}) END AS padded, CASE WHEN {h} > 0 THEN format('{{}}:{{:02d}}:{{:02d}}', {h}, {m}, {s}) ELSE format('{{}}:{{:02d}}', {m}, {s}) END AS clock FROM events",
        "text_formats": f"""SELECT p_partkey, format('{{}}_seg{{:03d}}', p_brand, p_partkey) AS segment, format('{{}}_ex{{:02d}}', p_brand, p_partkey) AS example, concat('concept_', {norm(PART_NAME)}) AS concept, 'is part of' AS label,
            concat(substring(repeat(p_name, 9), 1, 80), '...') AS preview, concat(p_name, '|', p_brand) AS listed, CASE p_partkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'o' WHEN 2 THEN '-' ELSE '.' END AS icon FROM part""",
        "excerpts": "SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), '...') ELSE text END AS excerpt FROM documents",
        "retry_rules": f"""SELECT event_id, least(CASE WHEN event_id % 3 = 0 THEN user_id + 2.0 ELSE 15.0 END, 30.0)::DOUBLE AS delay, CASE WHEN contains(m, 'insufficient_quota') THEN 'quota' WHEN contains(m, '429') THEN 'retry' ELSE 'raise' END AS action FROM (SELECT event_id, user_id, {message} AS m FROM events) x""",
        "json_fence_parse": "SELECT event_id, (props->>'k')::INT AS k FROM events",
        "json_defaults": f"""SELECT p_partkey, pos::INT AS pos, c->>'name' AS name, coalesce(c->>'type', 'definition') AS type, coalesce(c->>'definition', '') AS definition, coalesce(c->>'importance', 'mentioned') AS importance, coalesce(c->>'$.aliases[0]', '') AS aliases
            FROM (SELECT p_partkey, unnest([0, 1]) AS pos, unnest([j->0, j->1]) AS c FROM (SELECT p_partkey, {body}::JSON AS j FROM part) a) b""",
        "extract_concepts": _with("responses", ANSWERED) + """ SELECT video_id, segment_id, pos::INT AS pos, c->>'name' AS name, coalesce(c->>'type', 'definition') AS type, coalesce(c->>'definition', '') AS definition, coalesce(c->>'importance', 'mentioned') AS importance, 0 AS n_aliases
            FROM answered WHERE kind = 'concepts'""",
        "extract_relationships": _with("responses", ANSWERED) + """ SELECT video_id, segment_id, pos::INT AS pos, c->>'from_concept' AS from_concept, c->>'to_concept' AS to_concept, coalesce(c->>'type', 'depends_on') AS type, coalesce(c->>'evidence', '') AS evidence
            FROM answered WHERE kind = 'relationships' AND segment_id IN (SELECT segment_id FROM answered WHERE kind = 'concepts')""",
        "extract_metadata": _with("responses segments") + """ SELECT s.segment_id, coalesce(body::JSON->>'title', s.title) AS title, CASE WHEN json_array_length(body::JSON->'examples') > 0 THEN concat(body::JSON->>'$.examples[0].description', '/') END AS example
            FROM segments s JOIN responses r ON r.segment_id = s.segment_id AND kind = 'metadata'""",
        "global_relationships": _with("responses", ANSWERED) + """ SELECT video_id, 'global' AS segment_id, pos::INT AS pos, c->>'from_concept' AS from_concept, c->>'to_concept' AS to_concept, coalesce(c->>'type', 'depends_on') AS type, coalesce(c->>'evidence', '') AS evidence
            FROM answered WHERE kind = 'global' AND video_id IN (SELECT video_id FROM answered WHERE kind = 'concepts' GROUP BY video_id HAVING count(DISTINCT c->>'name') >= 2)""",
        "concept_defaults": _with("concepts") + """ SELECT name, CASE WHEN id % 3 <> 0 THEN type ELSE '' END AS type, CASE WHEN id % 4 <> 0 THEN definition ELSE '' END AS definition, CASE WHEN id % 5 <> 0 THEN importance ELSE '' END AS importance, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_aliases FROM concepts""",
        "segment_defaults": _with("segments") + """ SELECT segment_id, CASE WHEN seg_no % 3 <> 0 THEN title ELSE '' END AS title, CASE WHEN seg_no % 4 <> 0 THEN t0 ELSE 0.0 END AS start_s, CASE WHEN seg_no % 5 <> 0 THEN t1 ELSE 0.0 END AS end_s FROM segments""",
        "video_durations": _with("sentences") + " SELECT video_id, arg_max(t1, sent_idx) AS duration FROM sentences GROUP BY video_id",
        "prerequisites_summary": _with("concept_edges", DEPENDS, reach(10)) + " SELECT count(*) AS prerequisites, coalesce(max(depth), 0) AS max_depth FROM near",
        "link_counts": _with("mentions", REGISTERED, MERGED) + """ SELECT (SELECT count(DISTINCT name) FROM mentions) AS total, (SELECT count(*) FROM merged) AS resolved, count(*) AS edges
            FROM (SELECT DISTINCT c.name, segment_id, video_id FROM (SELECT name, unnest(list_concat([name], aliases)) AS called FROM merged) c JOIN mentions m ON m.name = c.called) e""",
        "unique_concepts": _with("mentions") + f" SELECT video_id, name, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases, (list(type ORDER BY seg_no, pos))[1] AS type, {BEST_DEF.format(o='seg_no, pos')} AS definition, {BEST_IMP.format(o='seg_no, pos')} AS importance FROM mentions GROUP BY video_id, name",
        "relationship_dedup": _with("relationships") + f""", t AS (SELECT *, {TURNED} AS turned FROM relationships), d AS (SELECT video_id, seg_no, segment_id, pos, CASE WHEN turned THEN to_concept ELSE from_concept END AS from_concept, CASE WHEN turned THEN from_concept ELSE to_concept END AS to_concept, type, evidence FROM t)
            SELECT segment_id, pos, from_concept, to_concept, type, evidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg_no, from_concept, to_concept, type ORDER BY pos) AS nth FROM d) x WHERE nth = 1""",
        "call_outcomes": _with("attempts", CALLS_ONLY) + " SELECT * FROM calls",
        "segment_outcomes": _with("attempts segments", CALLS) + " SELECT * FROM outcomes",
        "partial_results": _with("attempts segments", CALLS) + """ SELECT o.video_id, seg_no, o.segment_id, unnest(range(len(a)))::INT AS pos, json_extract_string(unnest(a), '$.name') AS name FROM (SELECT *, body::JSON::JSON[] AS a FROM calls WHERE kind = 'concepts' AND outcome = 'answered') c
            JOIN outcomes o ON o.segment_id = c.segment_id WHERE o.outcome = 'done' UNION ALL
            SELECT video_id, NULL, segment_id, NULL, body FROM calls WHERE kind = 'global' AND outcome = 'answered' AND video_id IN (SELECT video_id FROM outcomes GROUP BY video_id HAVING count(*) FILTER (outcome = 'done') > 0 AND count(*) FILTER (outcome = 'quota') = 0)""",
        "extraction_summary": _with("attempts segments", CALLS) + " SELECT * FROM summary",
        "batch_until_failure": _with("attempts segments videos", CALLS) + """ SELECT ordinal, video_id, CASE WHEN late THEN 'not run' WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT late THEN error END AS error
            FROM (SELECT *, coalesce(ordinal > min(ordinal) FILTER (error IS NOT NULL) OVER (), false) AS late FROM batch) b""",
        "batch_skipping_errors": _with("attempts segments videos", CALLS) + " SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, 0 AS not_run FROM batch",
        "vec_index_topk": INDEXED.format(t=TOPICS.format(turn=0), q=TOPICS.format(turn=0), where="", k=10),
        "vec_index_filtered": INDEXED.format(t=TOPICS.format(turn=0), q=TOPICS.format(turn=0), where="WHERE label = 3", k=25),
        "vec_index_upserted": INDEXED.format(t=f"{TOPICS.format(turn=0)} WHERE id % 3 <> 1 UNION ALL {TOPICS.format(turn=1)} WHERE id % 3 = 1 UNION ALL SELECT -id - 1, label, v FROM ({TOPICS.format(turn=0)}) WHERE id % 50 = 0", q=TOPICS.format(turn=0), where="", k=40),
        "topic_pairs": f"SELECT a.id AS idx_a, b.id AS idx_b, round(list_cosine_similarity(a.v, b.v), 4) AS sim FROM ({TOPICS.format(turn=0)}) a JOIN ({TOPICS.format(turn=0)}) b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.88",
        "graph_rebuilt_edges": _with("mentions relationships", KNOWN, EDGES) + " SELECT * FROM made",
        "graph_rebuilt_nodes": _with("mentions") + f""" SELECT * FROM (SELECT name, video_id, (list(type ORDER BY seg_no, pos))[1] AS type, {BEST_DEF.format(o='seg_no, pos')} AS definition, {BEST_IMP.format(o='seg_no, pos')} AS importance
            FROM mentions WHERE name NOT LIKE 'old%' GROUP BY video_id, name) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY video_id DESC) = 1""",
        "display_values": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '#f87171' WHEN 1 THEN '#fbbf24' WHEN 2 THEN '#34d399' ELSE '#94a3b8' END AS importance_colour,
            CASE p_partkey % 5 WHEN 0 THEN '#a78bfa' WHEN 1 THEN '#60a5fa' WHEN 2 THEN '#34d399' WHEN 3 THEN '#fbbf24' ELSE '#818cf8' END AS type_colour, round(CASE WHEN p_size % 3 > 0 THEN (p_partkey % 7) / (p_size % 3) * 100 ELSE 0 END, 6) AS progress FROM part""",
        "documents_checked": _with("videos segments") + """ SELECT video_id, CASE WHEN n % 7 = 0 THEN 'not a document of the schema' WHEN n % 11 = 0 THEN 'title is absent' ELSE '' END AS problem,
            CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN (SELECT count(*) FROM segments s WHERE s.video_id = v.video_id)::INT END AS n_segments, CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN duration END AS duration FROM (SELECT *, substring(video_id, 2)::BIGINT AS n FROM videos) v""",
        "concepts_ranked": _with("mentions") + f" SELECT name, importance, count(*) AS videos FROM (SELECT name, importance FROM (SELECT video_id, name, {BEST_IMP.format(o='seg_no, pos')} AS importance FROM mentions GROUP BY video_id, name) u ORDER BY {RANK} DESC, name LIMIT 50) x GROUP BY name, importance",
        "sources_gathered": _with("videos") + """ SELECT part, source, count(*) AS times, min(ordinal) AS first FROM (SELECT * FROM (SELECT 0 AS part, substring(video_id, 2)::BIGINT AS ordinal, source FROM videos UNION ALL SELECT 1, page_id, url FROM pages) s
            ORDER BY part, ordinal LIMIT (SELECT count(*) + 20 FROM videos)) t GROUP BY part, source""",
        "index_counts": f"""SELECT (SELECT count(*) FROM embeddings WHERE label <> 3) AS segments, (SELECT count(*) FROM (SELECT DISTINCT {PART_NAME} AS name, p_type FROM part)) AS concepts""",
        "resolved_end_to_end": f"""WITH RECURSIVE c AS (SELECT p_partkey AS idx, {PART_NAME} AS name, concat('part ', p_partkey) AS alias, p_type AS type, concat(p_brand, ' ', repeat('x', cast(p_partkey % 5 AS INT))) AS definition,
                CASE WHEN p_size < 17 THEN 'core' WHEN p_size < 34 THEN 'supporting' ELSE 'mentioned' END AS importance FROM part),
            v AS (SELECT vec_id AS idx, embedding AS e FROM embeddings WHERE vec_id IN (SELECT idx FROM c)), k AS (SELECT idx, {norm("name")} AS key FROM c UNION SELECT idx, {norm("alias")} FROM c),
            pairs AS (SELECT a.idx AS a, b.idx AS b FROM v a JOIN v b ON a.idx < b.idx WHERE list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.4 UNION SELECT a.idx, b.idx FROM k a JOIN k b ON a.key = b.key AND a.idx < b.idx),
            same AS (SELECT a, b FROM pairs WHERE (b - a) % 2 = 0 UNION SELECT b, a FROM pairs WHERE (b - a) % 2 = 0),
            near AS (SELECT idx, idx AS low FROM c UNION SELECT n.idx, s.b FROM near n JOIN same s ON s.a = n.low),
            grouped AS (SELECT c.*, component FROM c JOIN (SELECT idx, min(low) AS component FROM near GROUP BY idx) USING (idx)), {MERGED}
            SELECT idx, name, {ALIASES.format(x="aliases")} AS aliases, type, definition, importance, members FROM merged""",
        "dedup_registry": _with("crossing", REGISTRY) + """ SELECT video_id, segment_id, pos, cname AS name, array_to_string(caliases, '|') AS aliases, ctype AS type, cdef AS definition, importance
            FROM (SELECT e.*, cname, caliases, ctype, cdef, row_number() OVER (PARTITION BY e.video_id, seg_no, cname ORDER BY pos) AS nth FROM e JOIN nm ON nm.video_id = e.video_id AND nm.key = e.key) x WHERE nth = 1""",
        "dedup_relationships": _with("crossing relationships", REGISTRY) + f""", named AS (SELECT r.video_id, seg_no, segment_id, pos, coalesce(f.cname, from_concept) AS from_concept, coalesce(t.cname, to_concept) AS to_concept, type, evidence
                FROM (SELECT *, {norm("from_concept")} AS fk, {norm("to_concept")} AS tk FROM relationships) r LEFT JOIN nm f ON f.video_id = r.video_id AND f.key = fk LEFT JOIN nm t ON t.video_id = r.video_id AND t.key = tk),
            t AS (SELECT *, {TURNED} AS turned FROM named), d AS (SELECT video_id, seg_no, segment_id, pos, CASE WHEN turned THEN to_concept ELSE from_concept END AS from_concept, CASE WHEN turned THEN from_concept ELSE to_concept END AS to_concept, type, evidence FROM t)
            SELECT segment_id, pos, from_concept, to_concept, type, evidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg_no, from_concept, to_concept, type ORDER BY pos) AS nth FROM d) x WHERE nth = 1""",
        "concept_counts": _with("mentions") + f" SELECT video_id, count(*) AS mentions, count(DISTINCT name) AS names, count(DISTINCT key) AS names_after FROM (SELECT *, {norm('name')} AS key FROM mentions) m GROUP BY video_id",
        "concept_appearances": _with("mentions") + """ SELECT name, (list(type ORDER BY video_id, seg_no, pos))[1] AS type, (list(definition ORDER BY video_id, seg_no, pos))[1] AS definition, (list(importance ORDER BY video_id, seg_no, pos))[1] AS importance,
            count(DISTINCT concat(video_id, '/', segment_id)) AS appearances, count(DISTINCT video_id) AS videos FROM mentions GROUP BY name""",
        "graph_explained_in": _with("mentions", KNOWN) + " SELECT DISTINCT name AS concept, segment_id, video_id FROM mentions WHERE name IN (SELECT name FROM known)",
        "graph_belongs_to": _with("segments videos") + " SELECT segment_id, video_id FROM segments WHERE video_id IN (SELECT video_id FROM videos WHERE status <> 'failed')",
        "graph_relationships": _with("relationships", KNOWN, EDGES) + " SELECT src, dst, type, evidence, video_id FROM made",
        "graph_examples": _with("examples") + " SELECT example_id, concat('concept ', concept_id) AS concept FROM examples WHERE concept_id IN (SELECT p_partkey FROM part) AND concept_id % 10 <> 5",
        "graph_stats": _with("relationships", KNOWN, EDGES) + """ SELECT (SELECT count(*) FROM customer) AS videos, (SELECT count(*) FROM orders) AS segments, (SELECT count(*) FROM known) AS concepts,
            (SELECT count(*) FROM (SELECT DISTINCT video_id, from_concept, to_concept, upper(type) FROM relationships) r) AS relationships, (SELECT count(*) FROM made) AS relationships_made, (SELECT count(*) FROM events) AS examples""",
        "node_upsert": _with("videos") + """ SELECT video_id, CASE WHEN duration > 3000 THEN concat('new ', title) ELSE title END AS title, CASE WHEN duration > 3000 AND duration <= 6000 THEN NULL ELSE duration END AS duration, status FROM videos
            UNION ALL SELECT concat(video_id, 'n'), title, duration, NULL FROM videos WHERE duration < 0""",
        "constraint_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "concept_page": _with("concepts") + " SELECT name, importance, type FROM concepts ORDER BY importance DESC NULLS FIRST, name LIMIT 30 OFFSET 20",
        "graph_page_induced": _with("concept_edges", "pg AS (SELECT name FROM concepts ORDER BY importance DESC NULLS FIRST, name LIMIT 500)") + " SELECT src, dst, type FROM concept_edges WHERE src IN (SELECT name FROM pg) AND dst IN (SELECT name FROM pg)",
        "concept_detail_rels": _with("concept_edges", "it AS (SELECT name FROM concepts WHERE id = 42)") + " SELECT dst AS other, type, evidence FROM concept_edges WHERE src IN (SELECT name FROM it) UNION SELECT src, type, evidence FROM concept_edges WHERE dst IN (SELECT name FROM it)",
        "concept_segments": _with("explained_in segments videos concepts") + " SELECT s.segment_id, s.video_id, v.title AS video_title, t0 AS start_s FROM segments s JOIN videos v ON v.video_id = s.video_id WHERE s.segment_id IN (SELECT segment_id FROM explained_in WHERE concept = (SELECT name FROM concepts WHERE id = 42))",
        "video_list": _with("videos") + " SELECT video_id, title, coalesce(status, 'completed') AS status FROM videos ORDER BY title",
        "video_segments": _with("segments") + " SELECT segment_id, t0 AS start_s, t1 AS end_s, coalesce(t1 - t0, 0.0) AS seconds FROM segments WHERE video_id = 'v7' ORDER BY t0",
        "segment_concepts": _with("explained_in concepts") + " SELECT name, importance FROM concepts WHERE name IN (SELECT concept FROM explained_in WHERE segment_id = 's11')",
        "interval_lookup": _with("segments") + """ SELECT video_id, t, segment_id FROM (SELECT e.video_id, t, segment_id, row_number() OVER (PARTITION BY e.video_id, t ORDER BY t0, segment_id) AS nth
            FROM (SELECT DISTINCT concat('v', user_id) AS video_id, (event_id * 13 % 10000)::DOUBLE AS t FROM events) e JOIN segments s ON s.video_id = e.video_id AND t0 <= t AND t < t1) x WHERE nth = 1""",
        "timeline": _with("segments") + " SELECT video_id, segment_id, round(t0 / fin * 100, 6) AS left_pct, round((t1 - t0) / fin * 100, 6) AS width_pct FROM (SELECT *, first_value(t1) OVER (PARTITION BY video_id ORDER BY t0 DESC, segment_id DESC) AS fin FROM segments) s",
        "edge_merge": _with("concept_edges", "few AS (SELECT name FROM concepts WHERE importance <> 'core')") + " SELECT DISTINCT src, dst, type FROM concept_edges WHERE src IN (SELECT name FROM few) AND dst IN (SELECT name FROM few)",
        "status_summary": _with("videos") + " SELECT count(*) AS total, count(*) FILTER (status <> 'failed') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM videos",
        "prerequisites": _with("concept_edges explained_in segments videos", DEPENDS, PLACES, reach(10)) + " SELECT n.name, n.depth, c.definition, p.segment_id, p.video_id, p.t0 AS start_s FROM near n JOIN concepts c ON c.name = n.name LEFT JOIN first_place p ON p.name = n.name",
        "prerequisites_nearest": _with("concept_edges", DEPENDS, reach(10)) + " SELECT name, depth, row_number() OVER (ORDER BY depth, name) AS place FROM near ORDER BY depth, name LIMIT 40",
        "prerequisites_bounded": _with("concept_edges", DEPENDS, reach(4)) + " SELECT name, depth FROM near",
        "prereq_cyclic": _with("cyclic_edges", reach(20, "cyclic_edges", 100)) + " SELECT name, depth FROM near",
        "topo_levels": _with("concept_edges", DEPENDS, reach(20, first=0), "sub AS (SELECT src, dst FROM dep WHERE src IN (SELECT name FROM near) AND dst IN (SELECT name FROM near))", "climb AS (SELECT name, 0 AS level FROM near WHERE name NOT IN (SELECT src FROM sub) UNION SELECT s.src, c.level + 1 FROM climb c JOIN sub s ON s.dst = c.name)") + " SELECT name, max(level) AS level FROM climb GROUP BY name",
        "learning_path": _with("concept_edges explained_in segments videos", PATH) + " SELECT name, level, position, segment_id, seconds FROM steps",
        "learning_path_header": _with("concept_edges explained_in segments videos", PATH) + " SELECT (SELECT name FROM concepts WHERE id = (SELECT count(*) - 1 FROM part)) AS target, count(*) AS total_steps, sum(seconds) AS total_seconds, (SELECT string_agg(name, '|' ORDER BY name) FROM knows WHERE name IN (SELECT name FROM near)) AS skipped FROM steps",
        "alias_candidates": f"""WITH k AS (SELECT p_partkey AS idx, {norm("concat(p_name, ' ', p_partkey % 40)")} AS key FROM part UNION SELECT p_partkey, {norm("concat(p_brand, ' ', p_size)")} FROM part)
            SELECT DISTINCT a.idx AS idx_a, b.idx AS idx_b FROM k a JOIN k b ON a.key = b.key AND a.idx < b.idx""",
        "verdict_batches": f"""WITH {REGISTERED}, n AS (SELECT component AS idx_a, idx AS idx_b, row_number() OVER (ORDER BY component, idx) - 1 AS n FROM grouped WHERE idx <> component),
            b AS (SELECT *, n // 10 AS batch_no, n % 10 AS pair_index FROM n) SELECT b.idx_a, b.idx_b, 'SAME' AS verdict, concat(o.idx_a, ':', o.idx_b) AS reason FROM b JOIN b o ON o.batch_no = b.batch_no AND o.pair_index + o.batch_no % 2 = b.pair_index""",
        "components": """WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * 2) // 3 AS b FROM part WHERE p_partkey % 7 <> 0 AND p_partkey > 0),
            up AS (SELECT p_partkey AS id, p_partkey AS low FROM part UNION SELECT u.id, e.b FROM up u JOIN e ON e.a = u.low) SELECT id, min(low) AS component FROM up GROUP BY id""",
        "resolved_concepts": f"WITH {REGISTERED}, {MERGED} SELECT idx, name, {ALIASES.format(x='aliases')} AS aliases, type, definition, importance, members FROM merged",
        "cross_links": _with("mentions", REGISTERED, MERGED) + " SELECT DISTINCT c.name AS concept, segment_id, video_id FROM (SELECT name, unnest(list_concat([name], aliases)) AS called FROM merged) c JOIN mentions m ON m.name = c.called",
    }
    return found | {"streamed_sentences": found["sentence_grouping"], "components_followed": found["components"]}
