import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import centroid_clustering as clustering
from quillmap.llm import periodic_runs as runs
from quillmap.llm import url_filter as urls

from .conftest import CLASHING, messy_rows

SMALL = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


# periodic runs


def plain_runs(words):
    """Every maximal stretch for every period, then the least period of each."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text, weave=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if weave and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_the_query_agree_with_brute_force(spark, texts):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in runs.query(spark, SMALL).collect()}
    assert got == {k: plain_row(k, t) for k, t in texts.items()}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_runs_of_few_words_agree_with_brute_force(spark, monkeypatch):
    r = random.Random(5)
    made = []
    for k in range(300):
        words = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 90))]
        if k % 3 == 0:
            words += [r.choice("xyz") for _ in range(r.randint(1, 9))] * r.randint(2, 9) + words[:3]
        made.append((k, " ".join(words)))
    fibonacci, square = ["a", "a b"], "same " * 700
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    made += [(1000, fibonacci[-1]), (1001, square), (1002, "tick tock " * 300 + square), (1003, " ".join("01"[bin(k).count("1") % 2] for k in range(2048)))]
    monkeypatch.setattr(runs, "AT_ONCE", 1000)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in runs.periodic_runs(spark.createDataFrame(made, "doc_id long, text string").repartition(2)).collect()}
    assert got == {k: plain_row(k, t, False) for k, t in made}


def test_a_hash_that_deceives_is_found_out(monkeypatch):
    alike, asked = runs.PrefixHashes.alike, []

    class Deceived(runs.PrefixHashes):
        def __init__(self, ids, attempt):
            super().__init__(ids, attempt)
            self.attempt = attempt

        def alike(self, i, shift, length):
            asked.append(self.attempt)
            return alike(self, i, shift, length) if self.attempt else np.ones(len(i), bool)

    monkeypatch.setattr(runs, "PrefixHashes", Deceived)
    ids = np.array([1, 1, 1, 1, 1, 1, 1, 2, 1, 2, 3])
    assert runs.find_runs(ids, np.array([0, len(ids)])).T.tolist() == [[0, 7, 1]]
    assert {*asked} == {0, 1}


def test_runs_of_messy_rows(messy, nothing):
    got = runs.periodic_runs(messy, weave=runs.woven).collect()
    base = messy_rows()
    assert Counter(tuple(r) for r in got) == Counter((k, *plain_row(k, t)) for k, t, *_ in base if len(t or "") < 50_000) + Counter(tuple(r) for r in got if r.doc_id in (40, 41))
    assert len(got) == len(base)
    assert {(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in got if r.doc_id in (30, 31, 32)} == {(0, None, EMPTY, EMPTY)}
    assert runs.periodic_runs(nothing).columns == ["doc_id", *COLUMNS] and runs.periodic_runs(nothing).isEmpty()


def test_a_very_long_run_is_found(spark):
    made = [(1, "start " + "one two three " * 40_000 + "end"), (2, " ".join(f"w{k % 20_000}" for k in range(100_000)))]
    got = runs.periodic_runs(spark.createDataFrame(made, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [(1, 1, 120_000, 3, 40_000_000), (1, 0, 100_000, 20_000, 5000)]


# centroid clustering


def plain_clusters(rows, k, rounds, dims):
    """rows: (vec_id, vector). Lloyd's rounds in Python's whole numbers, row by row."""
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    at = [near(v) for _, v in kept]
    of = Counter()
    for d, n in at:
        of[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 2**63 else None
    return Counter((i, n, fits(d), fits(of[n]), fits(sum(of.values())), sha[n]) for (i, _), (d, n) in zip(kept, at))


FOUND = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def made_vectors(r, n, scale=1.0):
    base = [[r.choice((-1, 1)) * r.random() * scale for _ in range(4)] for _ in range(max(3, n // 4))]
    return [(k, r.choice(base)) for k in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.002, 3e4, 3e7])
def test_clusters_agree_with_brute_force(spark, scale):
    """Many repeated vectors and ties; the scales need doubles, 64 bits and longer numbers."""
    rows = made_vectors(random.Random(scale), 120, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = clustering.cluster_vectors(df, clusters=5, rounds=4, dims=4).select(*FOUND).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, 5, 4, 4)


def test_clusters_of_the_query_agree_with_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in clustering.query(spark, SMALL).select(*FOUND).collect()) == plain_clusters(rows, 8, 10, 64)


def test_clusters_of_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [5.0, -0.001]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, [1.0, 2.0, 3.0]), (1, [7.0, 7.0]), (10, [-0.0, 0.0])]
    extra = ", ".join(f"{c} string" for c in [*CLASHING, "vector", "cluster", "distance", "drawn"])
    df = spark.createDataFrame([(*row, *["?"] * (len(CLASHING) + 4)) for row in rows], f"vec_id long, embedding array<float>, {extra}").repartition(3)
    for k in (2, 8):
        got = clustering.cluster_vectors(df, clusters=k, dims=2).select(*FOUND).collect()
        assert Counter(tuple(r) for r in got) == plain_clusters(rows, k, 10, 2)
    assert clustering.cluster_vectors(df, dims=7).columns == FOUND
    assert clustering.cluster_vectors(df, dims=7).isEmpty() and clustering.cluster_vectors(df.limit(0), dims=2).isEmpty()


def test_one_vector_that_all_rows_have(spark):
    rows = [(k, [0.25, -0.75]) for k in range(500)] + [(500, [9.0, 9.0])]
    got = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=3, dims=2).select(*FOUND).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, 3, 10, 2)


# urls


def plain_url(url):
    after = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", after)[0]
    path = re.split(r"[?#]", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no address", "http://", "HTTP://EXAMPLE.NET", "http://example.net/", "http://example.net/en/", "http://Example.NET/en/x?y=/de/", "https://a.b.example.net/en", "x://notexample.net/en/1", "ftp://net/en/", "http://internet/x",
    "https://example.com/de/1", "https://www.example.com/de?x", "https://xexample.com/de/1", "https://example.com#/de/", "http://org/fr/", "http://ÄB.org/fr/x/y", "http://a.org//fr/", "a://b://c.net/d", "://x.net/a", "http://u@h.org:80/fr/1", "http://a.com/" + "s/" * 5000,
    "http://a.com/x\ny/z", "http://a.com/" + "l" * 100_000, "http://a.net\\/x", "/relative://y.net/",
]


def test_rules_of_urls(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.org/fr/"), (3, "http://"), (3, "http://")]
    extra = ", ".join(f"{c} string" for c in [*CLASHING, "host", "path", "shape", "rule", "good", "purity"])
    df = spark.createDataFrame([(*r, *["?"] * (len(CLASHING) + 6)) for r in rows], f"page_id long, url string, {extra}").repartition(3)
    labelled = spark.createDataFrame([("http://a.com/1", None), (None, True)], "url string, good boolean")
    got = urls.judge_urls(df, labelled).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((k, h, p, rule, v or "allow") for k, u in rows for h, p, rule, v in [plain_url(u)])
    assert urls.judge_urls(df.limit(0), labelled).isEmpty()


def site(host, section, n, good, start=0):
    """n urls of a section, so many of whose labels are good."""
    return [(f"http://{host}/{section}/{start + k}.html", k < good) for k in range(n)]


def test_templates_are_rejected_by_the_purity_of_their_section(spark):
    known = site("s.com", "news", 60, 58) + site("s.com", "spam", 60, 3) + site("s.com", "blog", 60, 57) + site("good.com", "spam", 60, 59)
    known += [(f"http://s.com/{word}/page", k % 10 > 0) for k, word in enumerate(f"title-{a}{b}" for a in "abcdefghij" for b in "abcdef")]
    fresh = ["http://s.com/news/999.html", "http://s.com/spam/999.html", "http://s.com/spam/777.html?x", "http://good.com/spam/999.html", "http://s.com/other-title/page", "http://new.com/spam/1"]
    pages = spark.createDataFrame(list(enumerate([u for u, _ in known] + fresh)), "page_id long, url string")
    got = {r.page_id - len(known): r for r in urls.judge_urls(pages, spark.createDataFrame(known, "url string, good boolean")).collect()}
    assert [got[k].verdict for k in range(6)] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert got[1].template == "/spam/#.html" and "blog|news" in got[0].template and got[4].template.startswith("/*")


def test_sections_with_like_labels_are_one(spark):
    known = site("s.com", "en", 40, 30) + site("s.com", "fr", 40, 31) + site("s.com", "de", 40, 4)
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(known)], "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(known, "url string, good boolean")).groupBy("template", "verdict").count().collect()
    assert {tuple(r) for r in got} == {("/en|fr/#.html", "allow", 80), ("/de/#.html", "block", 40)}


def test_labels_of_documents_are_found_by_the_end_of_the_path(spark):
    pages = spark.createDataFrame([("http://a.com/en/12?x=3",), ("http://a.com/en/13.html#y",), ("http://a.com/14/",), ("http://a.com/15/x",), ("http://a.com/" + "9" * 30,), (None,)], "url string")
    labels = spark.createDataFrame([(12, 1), (12, 0), (13, 1), (14, None), (15, 1), (None, 1)], "doc_id long, quality int")
    assert {tuple(r) for r in urls.labelled_urls(pages, labels).collect()} == {("http://a.com/en/12?x=3", False), ("http://a.com/en/13.html#y", True), ("http://a.com/14/", None)}


def test_urls_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    got = urls.query(spark, "/root/testdata/sf0.1")
    columns = sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({urls.SQL})").fetchall())
    assert got.filter(F.col("rule").isNull()).groupBy("verdict").count().count() >= 1
