import hashlib
import random
import re

import numpy as np
import pytest

from quillmap.llm import exact_dedup, ngram_join, signature_tree, substring_dedup
from quillmap.llm.components import components
from quillmap.operators.iteration import Steps

from .conftest import messy_rows


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups_of(rows):
    out = {}
    for doc_id, text, *_ in rows:
        out.setdefault(normal(text), []).append(doc_id)
    return out


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_of_messy_rows(messy, digest_all):
    got = exact_dedup.exact_dedup(messy, digest_all=digest_all).collect()
    groups = groups_of(messy_rows())
    by_size = {}
    for r in got:
        by_size.setdefault((r.keep_id, r.group_size), []).append(r)
    assert len(got) == len(messy_rows())
    want = {(min((i for i in ids if i is not None), default=None), len(ids)) for ids in groups.values()}
    assert set(by_size) == want
    assert sum(r.kept for r in got) == len(groups)
    if digest_all:
        sums = {hashlib.sha256(t.encode()).hexdigest() for t in groups}
        assert {r.text_sha256 for r in got} == sums


def test_exact_dedup_agrees_with_brute_force(small, texts):
    groups = groups_of(texts.items())
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(small, digest_all=True).collect()}
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_dropping_copies_keeps_one_row_of_each_text(messy):
    left = exact_dedup.drop_copies(messy)
    assert left.columns == messy.columns
    texts = [normal(r.text) for r in left.collect()]
    assert sorted(texts) == sorted(groups_of(messy_rows()))


def test_empty_tables(nothing):
    assert exact_dedup.exact_dedup(nothing).isEmpty() and exact_dedup.drop_copies(nothing).isEmpty()
    assert ngram_join.near_duplicates(nothing).isEmpty() and ngram_join.keep_first(nothing).isEmpty()
    assert substring_dedup.repeated_passages(nothing).isEmpty()


def shingle_sets(texts, k):
    out = {}
    for key, t in texts.items():
        w = (t or "").encode().lower().split()
        out[key] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def linked_components(sets, p):
    label = {k: k for k in sets}
    keys = list(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and 100 * (o := len(sets[a] & sets[b])) >= p * (len(sets[a]) + len(sets[b]) - o)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("k, p", [(3, 90), (5, 80)])
def test_join_agrees_with_brute_force(small, texts, k, p):
    sets = shingle_sets(texts, k)
    want = linked_components(sets, p)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(small, k=k, percent=p).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("shingles, docs", [(400, 8192), (2_000_000, 6)])
def test_split_clusters_lose_no_link(spark, monkeypatch, shingles, docs):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    r = random.Random(9)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    texts = {}
    for i in range(40):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 6, 12])):
            w[r.randrange(len(w))] = f"v{r.randint(0, 5000)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = shingle_sets(texts, 3)
    want = linked_components(sets, 80)
    assert len(set(want.values())) > 2
    assert {x.doc_id: x.component_id for x in ngram_join.near_duplicates(df, k=3, percent=80).collect()} == want


def test_join_of_messy_rows(messy):
    got = ngram_join.near_duplicates(messy).collect()
    assert len(got) == len(messy_rows())
    at = {}
    for r in got:
        at.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert at[20][0][1] == 0 and at[21][0][1] == 0 and at[22][0][1] == 1
    assert at[30] == [(0, 30)] and at[31] == [(0, 31)] and at[32] == [(0, 32)] and at[33] == [(1, 33)]
    assert all(c is None for _, c in at[None])
    kept = [r.doc_id for r in ngram_join.keep_first(messy).collect()]
    assert {20, 21, 22}.isdisjoint(kept) and {0, 1, 30, 31, 32, 33}.issubset(kept) and kept.count(None) == 3


def test_sets_that_link_share_a_key():
    r = np.random.default_rng(5)
    linked = 0
    for trial in range(1500):
        p = (80, 90)[trial % 2]
        u = np.unique(r.integers(0, 2**64, int(r.choice([1, 2, 4, 5, 8, 9, 10, 11, 19, 20, 30, 60, 200, 450])), dtype=np.uint64))
        k = int(r.integers(0, len(u) * (100 - p) // (100 + p) + 1))
        v = np.unique(np.r_[np.delete(u, r.choice(len(u), k, replace=False)), r.integers(0, 2**64, int(r.integers(0, k + 1)), dtype=np.uint64)])
        if len(v) and signature_tree.linked(u, v, p):
            linked += 1
            assert len(np.intersect1d(ngram_join.segment_keys(u, p), ngram_join.segment_keys(v, p)))
    assert linked > 800


def test_tree_agrees_with_all_pairs():
    r = np.random.default_rng(8)
    for _ in range(8):
        base = [np.unique(r.integers(0, 2**64, int(r.integers(20, 200)), dtype=np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(int(r.integers(2, 320))):
            x = base[int(r.integers(0, 6))]
            x = np.delete(x, r.choice(len(x), int(len(x) * r.random() * 0.15), replace=False))
            sets.append(np.unique(np.r_[x, r.integers(0, 2**64, int(r.integers(0, 8)), dtype=np.uint64)]))
        want = linked_components({i: set(s.tolist()) for i, s in enumerate(sets)}, 85)
        assert signature_tree.join_group(np.arange(len(sets)), sets, 85).tolist() == [want[i] for i in range(len(sets))]


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_components_of_a_long_chain(spark):
    n = 3000
    got = components(spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert got.groupBy("component").count().collect() == [(0, n + 1)]


def test_join_of_a_chain_of_near_copies(spark):
    """Each text is the one before, shifted by ten words, so that links chain through all of them."""
    r = random.Random(21)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(200 + 10 * 180)]
    texts = {i: " ".join(words[10 * i : 10 * i + 200]) for i in range(180)} | {500 + i: " ".join(r.sample(words, 150)) for i in range(20)}
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=3, percent=90).collect()}
    assert got == linked_components(shingle_sets(texts, 3), 90) and {got[i] for i in range(180)} == {0}


def test_join_finds_all_links_of_whole_clusters(spark):
    """Recall against all pairs, over the documents of a larger table that have a close one, and as many others."""
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == linked_components(shingle_sets(docs, 5), 80)


def test_a_key_of_many_documents_is_counted_once(spark):
    keys = spark.createDataFrame([(i, 7) for i in range(300)] + [(i, 1000 + i % 299) for i in range(300)] + [(0, 8), (1, 8), (0, 9), (1, 9)], "node long, key long")
    got = {}
    with Steps(spark) as steps:
        found = ngram_join.buckets_of(keys, steps).collect()
    for x in found:
        got.setdefault((x.bucket, x.n), set()).add(x.node)
    assert sorted((n, sorted(v)) for (_, n), v in got.items()) == [(2, [0, 1]), (2, [0, 299]), (300, list(range(300)))]


def passages(r, count, copies, words):
    """Documents of random words, the first `copies` with a passage in common, and where that stands."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    passage = [word() for _ in range(words)]
    rows, want = [], []
    for i in range(count):
        w = [f"{word()}{i}" for _ in range(200)]  # no other document's
        if i < copies:
            at = r.randint(0, 200)
            w[at:at] = [x.upper() if i % 2 else x for x in passage]
            want.append((i, len(" ".join(w[:at])) + bool(at), len(" ".join(passage)), words))
        rows.append((i, ("\n" if i % 3 else " ").join(w)))
    return rows, want


@pytest.mark.parametrize("words", [50, 51, 60, 300])
def test_passages_that_documents_share(spark, words):
    rows, want = passages(random.Random(words), 30, 15, words)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start, x.length, x.n_words) for x in got) == want
    assert all(x.keep_id == 0 and x.is_copy == (x.doc_id != 0) for x in got)


def test_a_passage_within_a_longer_one_is_found(spark):
    """Two documents share 400 words, and others only some of those."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    long = [word() for _ in range(400)]
    rows, want = [], []
    for i in range(24):
        a = r.randint(0, 340)
        b = a + r.randint(52, 60)
        part = long if i < 2 else long[a:b]
        before, after = ([f"{word()}{i}" for _ in range(r.randint(1, 90))] for _ in range(2))
        rows.append((i, " ".join([*before, *part, *after])))
        want.append((i, len(" ".join(before)) + 1, len(" ".join(part)), len(part)))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start, x.length, x.n_words) for x in got) == want


def test_shorter_passages_are_left_alone(spark):
    rows, _ = passages(random.Random(1), 20, 10, 45)
    assert substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).isEmpty()


def test_passages_agree_with_brute_force(spark):
    """Documents with 50 words in a row that another document has, over a whole larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    found, owners = substring_dedup.repeated_passages(docs).collect(), {}
    for i, t in texts.items():
        w = t.encode().translate(substring_dedup.FOLD).split()
        for k in range(len(w) - 49):
            owners.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*[v for v in owners.values() if len(v) > 1])
    got = {x.doc_id for x in found}
    assert want <= got and len(got - want) <= 0.01 * len(texts) and len(want) > 100
    inside = lambda x: texts[x.doc_id][x.start : x.start + x.length].encode().translate(substring_dedup.FOLD).split()
    assert all(len(inside(x)) == x.n_words >= 50 for x in found)
    # every word of 50 in a row that another document has lies in a passage, and every word of a passage in such 50
    covered, shared = {}, {}
    for x in found:
        first = len(texts[x.doc_id][: x.start].encode().translate(substring_dedup.FOLD).split())
        covered.setdefault(x.doc_id, set()).update(range(first, first + x.n_words))
    for i, t in texts.items():
        w = t.encode().translate(substring_dedup.FOLD).split()
        starts = [k for k in range(len(w) - 49) if len(owners[tuple(w[k : k + 50])]) > 1]
        shared[i] = {k + j for k in starts for j in range(50)}
    missed, more = (sum(len(a.get(i, set()) - b.get(i, set())) for i in texts) for a, b in ((shared, covered), (covered, shared)))
    every = sum(map(len, shared.values()))
    assert missed <= 0.002 * every and more <= 0.002 * every, (missed, more, every)


def test_an_insertion_moves_boundaries_near_it_only():
    r = np.random.default_rng(2)
    data = r.integers(97, 123, 5000).astype(np.uint8)
    a = substring_dedup.boundaries(data)
    b = substring_dedup.boundaries(np.insert(data, 2500, 65))
    near = substring_dedup.STRETCH + 8
    assert set(a[a < 2500 - near]) <= set(b) and set(a[a > 2500 + near] + 1) <= set(b)
    for x in (data, np.full(10_000, 97, np.uint8), np.frombuffer(b"ha " * 900, np.uint8), data[:50], data[:80]):
        ends = substring_dedup.boundaries(x)
        assert ends[-1] == len(x) and max(np.diff(ends, prepend=0)) <= substring_dedup.STRETCH and min(np.diff(ends, prepend=0)) > 0


def test_passages_of_messy_rows(messy):
    got = substring_dedup.repeated_passages(messy).collect()
    ids = {r.doc_id for r in got}
    assert {0, 1, 2, 20, 21, 22, None} <= ids and {5, 30, 31, 32, 33, 34}.isdisjoint(ids)
    lone = [r for r in got if r.doc_id is None]
    assert len(lone) == 1 and lone[0].keep_id == 2 and lone[0].is_copy
