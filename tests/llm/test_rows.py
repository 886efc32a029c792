import json
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmap.llm import license_scan, license_templates, mixing, packing, personal_data, quality_classifier, quality_rules, sharding

from .conftest import messy_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (packing.pack(nothing), quality_classifier.quality_scores(nothing, labels), quality_rules.quality_rules(nothing), license_scan.license_scan(nothing), mixing.mix_sources(nothing), sharding.balanced_shards(nothing), personal_data.personal_data(nothing)):
        assert df.isEmpty()


# sharding


def check_shards(rows, texts):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    return {k: sum(r.size for r in s) for k, s in shards.items()}


def test_shards_are_equal_and_contiguous(small, texts):
    rows = sharding.balanced_shards(small).collect()
    sizes = check_shards(rows, texts.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    order = sorted(rows, key=lambda r: r.doc_id)
    assert [r.shard for r in order] == sorted(r.shard for r in order)
    assert all(r.shard == min(7, r.start_byte * 8 // sum(sizes.values())) for r in rows)


def test_shards_of_messy_rows(messy):
    check_shards(sharding.balanced_shards(messy).collect(), [r[1] for r in messy_rows()])


# mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    got, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), {s for s in order if sizes[s]}
    while left > 1e-6:
        share, left = left / sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=str):
            got[s] += share * weight[s]
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
        free = {s for s in free if got[s] < 2 * sizes[s]}
    return got


def check_mix(rows, source_rows):
    sizes = {}
    for _, text, _, source, *_ in source_rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    assert sorted((r.size, r.source_size) for r in rows) == sorted((len(WORD.findall(t or "")), sizes[s]) for _, t, _, s, *_ in source_rows)
    by_target = {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    for s, t in want.items():
        assert (sizes[s], round(t, 6)) in by_target
    return {k: sum(r.taken for r in v) for k, v in by_target.items()}


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r)[:4] for r in docs.collect()]
    taken = check_mix(mixing.mix_sources(docs).collect(), rows)
    assert all(abs(n - t) <= 0.02 * t + 5 for (_, t), n in taken.items())


def test_mix_reruns_agree(small):
    taken = lambda docs: sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect())
    assert taken(small) == taken(small.repartition(5))


def test_mix_of_messy_rows(messy):
    check_mix(mixing.mix_sources(messy).collect(), messy_rows())
    taken = mixing.take_mix(messy)
    assert taken.columns == messy.columns
    total = sum(len(WORD.findall(r.text or "")) for r in taken.collect())
    mix = mixing.mix_sources(messy).collect()
    assert total == sum(r.taken for r in mix)


def test_tilt_solves_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 5), ("a", 200, 3), ("a", 3000, 1)], "source string, size long, n long")
    for target in (900.0, 3650.0, 5000.0, 7200.0):
        t = spark.createDataFrame([("a", 3650, target)], "source string, words long, target double")
        tilt = mixing.balance(cells, t).first().tilt
        assert sum(n * x * min(2, np.exp(tilt * x)) for x, n in ((10, 5), (200, 3), (3000, 1))) == pytest.approx(target, rel=1e-5)


# packing


def check_pack(pieces, texts, window=2048):
    encode = vocabulary()
    left = {}
    for r in pieces:
        left.setdefault(r.doc_id, []).append((r.start, tuple(r.ids)))
        assert r.length == len(r.ids)
    for doc_id, want in texts.items():
        ids = [tuple([*encode(t, add_special_tokens=False).ids, 1]) for t in want]
        cut = sorted((k, x[k : k + window]) for x in ids for k in range(0, len(x), window))
        assert sorted(left[doc_id]) == cut
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
        padding += window - at
    return padding / sum(r.length for r in pieces)


def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode


def test_ids_are_those_of_the_vocabulary(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own, encode = packing.encoder(packing.tokenizer_path()), vocabulary()
    for text in [*texts, "<|endoftext|> a  b\n\n c", "", "日本語 ñ é", "x" * 3000, "a\u00a0\u2003 b", "\ud7ff \U0001f600\u200d", "it's  we'LL\t\r\n 12345 !?"]:
        assert encode(text, add_special_tokens=False).ids == own(text).tolist()


def test_special_strings_and_long_white_space_give_the_ids_of_the_vocabulary(spark):
    encode = vocabulary()
    rows = [(0, "one <|endoftext|> two"), (1, "a" + " " * 1_100_000 + "b"), (2, "<|endoftext|>"), (3, "<|endof text|>")]
    ids = {i: [*encode(t, add_special_tokens=False).ids, packing.END] for i, t in rows}
    assert ids[0] == [505, 220, 50256, 734, packing.END] and len(ids[1]) > 1_100_000
    got = {}
    for r in sorted(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    assert got == ids


def test_packing_is_whole_and_tight(small, texts):
    assert check_pack(packing.pack(small).collect(), {k: [t] for k, t in texts.items()}) < 0.03


def test_packing_of_messy_rows(messy):
    want = {}
    for doc_id, text, *_ in messy_rows():
        want.setdefault(doc_id, []).append(text or "")
    pieces = packing.pack(messy).collect()
    check_pack(pieces, want)
    sums = packing.pack(messy, ids=False, digests=True).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.length)
    assert sorted((*key(r), r.ids_crc32) for r in sums) == sorted((*key(r), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in pieces)


def test_patterns_are_all_pairs_and_triples():
    have = np.array([1, 2, 3, 5, 8, 13, 40])
    want = {(a, b, c) for a in have for b in have for c in [0, *have] if a >= b >= c and a + b + c == 21}
    got = packing.patterns(np.append(have, 21), 21)
    assert {tuple(x[:3]) for x in got if not x[3]} == want and all(x.sum() == 21 and set(x) <= {0, *have} for x in got)


def test_counts_solve_least_squares():
    h = np.zeros(101, np.int64)
    h[[30, 70, 20, 50, 60]] = [500, 500, 300, 400, 150]  # 70 + 30, 50 + 50, 60 + 20 + 20 and others fill the window
    combos = packing.patterns(np.flatnonzero(h), 100)
    x = packing.solve(combos, h)
    used = np.bincount(combos.ravel(), np.repeat(x, packing.DEPTH), 101)
    used[0] = 0
    assert (x >= 0).all() and np.abs(used - h).max() < 5


def test_plans_use_each_piece_once():
    r = np.random.default_rng(1)
    for n in (0, 5, 500, 200_000):
        h = np.bincount(np.minimum(2048, 1 + r.geometric(1 / 500, n)), minlength=2049)
        used, filled = np.zeros(2049, int), 0
        for times, combo in packing.plan_sequences(h, 2048):
            assert times > 0 and sum(combo) <= 2048
            np.add.at(used, list(combo), times)
            filled += times
        assert (used == h).all()
        assert n < 500 or filled * 2048 < 1.01 * (h * np.arange(2049)).sum() + 4096


# quality rules


def measures(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    n = len(covered)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))


def rule_row(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_rules_agree_with_brute_force(small, texts):
    for r in quality_rules.quality_rules(small).collect():
        assert rule_row(r) == measures(texts[r.doc_id])
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.failed == "")


def quantile_cutoffs(rows, measures):
    """Cutoffs of each (lang, source) from rows (lang, source, {measure: value}), as quality_rules defines them, by plain lists."""
    gamma = (1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY)
    least = quality_rules.LEAST

    def marks(values):
        buckets = sorted(max(0, math.ceil(math.log(v / least) / math.log(gamma))) if v > least else 0 for v in values)
        at = lambda q: buckets[max(0, math.ceil(q * len(buckets) - 1e-9) - 1)]
        return [least * gamma**b * 2 / (1 + gamma) if b else 0.0 for b in map(at, (0.25, 0.75, 1 - quality_rules.TOP, quality_rules.TOP))]

    out = {}
    for lang, source in {(r[0], r[1]) for r in rows}:
        for m in measures:
            own, of_lang, all_ = ([r[2][m] for r in rows if f(r)] for f in (lambda r: r[:2] == (lang, source), lambda r: r[0] == lang, lambda r: True))
            w, v = len(own) / (len(own) + quality_rules.EVEN_ROWS), len(of_lang) / (len(of_lang) + quality_rules.EVEN_ROWS)
            q1, q3, bottom, top = (w * a + (1 - w) * (v * b + (1 - v) * c) for a, b, c in zip(marks(own), marks(of_lang), marks(all_)))
            upper, spread = q3 + 3 * (q3 - q1), q3 - q1
            high = max(upper, top) if m in quality_rules.SPARSE else upper if spread > 0 else top
            low = (q1 - 3 * spread if spread > 0 else bottom) / gamma if quality_rules.MEASURES[m] else -1.0
            out[lang, source, m] = (low, max(least, high * gamma))
    return out


def test_kept_agrees_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {}
    for r in docs.collect():
        n_words, chars, symbols, dup, repeat, base = measures(r.text or "")
        flat = " ".join(WORD.findall(r.text or ""))
        lines = sum(bool(WORD.search(x)) for x in (r.text or "").split("\n"))
        n = max(1, n_words)
        own = {"symbols_per_word": symbols / n, "marks_per_word": len(re.findall(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", flat)) / n, "capitals_per_char": len(re.findall("[A-Z]", flat)) / max(1, len(flat)), "dup_line_share": dup / max(1, lines), "repeat_share": repeat / n, "chars_per_word": chars / n}
        rows[r.doc_id] = (r.lang, r.source, own, base)
    passing = [r for r in rows.values() if not r[3]]
    outside = lambda r, cut, of: {m for m in of if (r[0], r[1], m) in cut and not cut[r[0], r[1], m][0] <= r[2][m] <= cut[r[0], r[1], m][1]}
    graded = quantile_cutoffs(passing, quality_rules.GRADED)
    sparse = quantile_cutoffs([r for r in passing if not outside(r, graded, quality_rules.GRADED)], quality_rules.SPARSE)
    failed = {i: outside(r, graded, quality_rules.GRADED) | outside(r, sparse, quality_rules.SPARSE) for i, r in rows.items()}
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i: set(filter(None, r.failed.split(","))) for i, r in got.items()} == failed
    assert {i for i, r in got.items() if r.kept} == {i for i, r in rows.items() if not r[3] and not failed[i]}


def test_rules_of_messy_rows(messy):
    got = quality_rules.quality_rules(messy).collect()
    assert sorted(map(rule_row, got)) == sorted(measures(t or "") for _, t, *_ in messy_rows())


def test_cutoffs_follow_the_group_where_quartiles_are_equal(spark):
    import random

    r = random.Random(5)
    line = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(5))

    def text(copies, signs):
        lines = [line() for _ in range(25 - copies)]
        return "\n".join([*lines, *lines[:copies]]) + " #" * signs

    rows = [(k, text(0, 0), "en", "plain") for k in range(298)] + [(298, text(4, 0), "en", "plain"), (299, text(0, 12), "en", "plain")]
    rows += [(300 + k, text(4 * (k % 10 == 0), 0), "en", "listing") for k in range(300)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert "dup_line_share" in got[298].failed and "repeat_share" in got[298].failed and "symbols_per_word" in got[299].failed
    assert not any({"dup_line_share", "repeat_share", "symbols_per_word"} & set(got[k].failed.split(",")) for k in range(300, 600))
    assert sum(got[k].kept for k in range(298)) > 280


def test_cutoffs_change_smoothly_with_the_rows_of_a_group(spark):
    def high(n):
        rows = [("en", "small", *[0.1 + 0.01 * (k % 10)] * 6) for k in range(n)] + [("en", "large", *[1 + 0.1 * (k % 10)] * 6) for k in range(1000)]
        df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m in quality_rules.MEASURES))
        return quality_rules.fences(quality_rules.sketch(df), tuple(quality_rules.MEASURES)).filter("source = 'small'").first().high_marks_per_word

    few, below, at, many = high(10), high(99), high(100), high(3000)
    assert below == pytest.approx(at, rel=0.02) and few > at > many


def test_sketches_merge_and_hold_their_accuracy(spark):
    r = np.random.default_rng(0)
    rows = [("en", "ab"[k % 2], *[float(x)] * len(quality_rules.MEASURES)) for k, x in enumerate(r.lognormal(0, 1, 4000))]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m in quality_rules.MEASURES))
    whole = quality_rules.sketch(df).groupBy("measure", "bucket").sum("n")
    halves = quality_rules.sketch(df.filter("source = 'a'")).union(quality_rules.sketch(df.filter("source = 'b'"))).groupBy("measure", "bucket").sum("n")
    assert sorted(whole.collect()) == sorted(halves.collect())
    q = quality_rules.quartiles(whole.withColumnRenamed("sum(n)", "n"), []).first()
    values = sorted(x[2] for x in rows)
    assert q.q1 == pytest.approx(values[999], rel=0.021) and q.q3 == pytest.approx(values[2999], rel=0.021)


# license scan


def license_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    at = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))


def license_row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_licenses_agree_with_brute_force(small, texts):
    for r in license_scan.license_scan(small).collect():
        assert license_row(r) == license_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licenses_of_messy_rows(messy):
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(license_row, license_scan.license_scan(messy).collect()), key=key) == sorted((license_base(t or "") for _, t, *_ in messy_rows()), key=key)


def test_license_texts_are_found_with_insertions(spark):
    mit = "so Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction and"
    rows = [(1, mit), (2, "Licensed under CC BY-NC 4.0."), (3, "permission is granted to copy the words of this text"), (4, "The MIT License. " * 3)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["mit", "cc-by-nc", "", "mit"]
    assert got[4].n_base == 3 and got[4].score == 1.0 and got[3].score < 0.5 and got[1].score > 0.7


def license_votes(text, templates):
    """Labels, spans and the largest share by diagonal voting, from lists of words."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    w, spans, best = words_of(text), set(), 0.0
    k = license_scan.K
    at = {}
    for i in range(len(w) - k + 1):
        at.setdefault(tuple(w[i : i + k]), []).append(i)
    for label, template in templates:
        t = words_of(template)
        hits = sorted((i - j, i, j) for j in range(len(t) - k + 1) for i in at.get(tuple(t[j : j + k]), []))
        bands = []
        for hit in hits:
            if not bands or hit[0] - bands[-1][-1][0] > license_scan.NEAR:
                bands.append([])
            bands[-1].append(hit)
        for band in bands:
            share = min(1.0, len({j + d for _, _, j in band for d in range(k)}) / len(t))
            first, last = min(i for _, i, _ in band), max(i for _, i, _ in band) + k
            best = max(best, share)
            if share >= license_scan.COVERED and last - first <= 2 * len(t):
                spans.add((label, first, last))
    return sorted(spans), best


def license_documents():
    """Whole licenses as they are, cut, reworded and with insertions, within prose; and prose alone."""
    r = random.Random(31)
    prose = lambda n: [r.choice("this work is one of those that the people of our land have used and may copy in any way without permission or notice license software".split()) for _ in range(n)]
    rows, labels = [], {}
    for label, text in license_templates.WHOLE + license_templates.BODIES:
        for change in ("none", "cut", "reworded", "inserted"):
            w = text.split()
            if change == "cut":
                w = w[: len(w) * 4 // 5]
            elif change == "reworded":
                w = [x if r.random() > 0.03 else r.choice(prose(1)) for x in w]
            elif change == "inserted":
                w = [y for x in w for y in ([x] if r.random() > 0.02 else [x, *prose(1)])]
            labels[len(rows)] = label
            rows.append((len(rows), " ".join(prose(r.randint(0, 80)) + w + prose(r.randint(0, 80)))))
    return rows + [(1000 + i, " ".join(prose(300))) for i in range(40)], labels


def test_license_votes_agree_with_brute_force(spark):
    rows, labels = license_documents()
    rows += [(2000, "The MIT License and the Apache License. Licensed under CC BY 4.0"), (2001, ""), (2002, None)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans, best = license_votes(text or "", license_scan.TEMPLATES)
        base = license_base(text or "")[4]
        assert [(x["label"], x["first"], x["last"]) for x in json.loads(got[i].spans)] == spans
        assert got[i].labels == ",".join(sorted({x[0] for x in spans} | set(filter(None, base.split(",")))))
        assert got[i].score == (1.0 if base else pytest.approx(best))


def test_bodies_are_found_without_their_notice(spark):
    """The grant or preamble of a long license among other sections of it, line by line, with a few words altered."""
    r = random.Random(5)
    section = lambda: " ".join(r.choice("you may not propagate or modify a covered work except as expressly provided under this section the conveying of source code must be under these terms".split()) for _ in range(400))
    rows, labels = [], {}
    for label, text in license_templates.BODIES * 3:
        w = [x if r.random() > 0.02 else "altered" for x in text.split()]
        lines = [" ".join(w[k : k + 11]) for k in range(0, len(w), 11)]
        labels[len(rows)] = label
        rows.append((len(rows), section() + "\n  " + "\n   ".join(lines) + "\n" + section()))
    rows.append((99, section() + section()))
    got = {x.doc_id: set(x.labels.split(",")) for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(label in got[i] for i, label in labels.items()) >= 0.9 * len(labels) and got[99] == {""}


def test_whole_licenses_are_found_where_cut_or_reworded(spark):
    rows, labels = license_documents()
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(label in got[i] for i, label in labels.items()) >= 0.9 * len(labels)
    assert all(got[i] == {""} for i in got if i >= 1000)


# personal data


def base_by_regex(t):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_patterns_agree_with_plain_expressions(texts):
    import random

    r = random.Random(6)
    made = ["".join(r.choice(["a", "b.", "@", "@c.d", "1", "12.", "1.2.3.4", "4111 1111 1111 1111", "+1 ", "(5) ", "-", " ", "é", "999", "x@y.z-w.q"]) for _ in range(30)) for _ in range(400)]
    for t in [*texts.values(), *made]:
        assert personal_data.base_spans(t) == base_by_regex(t)


def test_long_texts_cost_no_square(messy):
    assert personal_data.base_spans("a" * 2_000_000 + "@") == [] and personal_data.base_spans("1" * 2_000_000) == []


def test_field_adds_spans_and_leaves_clean_texts_alone():
    weights = personal_data.trained()
    text = 'The card 4417.7442.8035.1547 and token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" of someone, order 4417 7442 8035 1548.'
    base, spans = personal_data.all_spans(text, weights)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [("card", "4417.7442.8035.1547"), ("secret", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6")]
    for clean in ("Licensed under CC BY-NC 4.0.", "In 1999 there were 42 of them, 7% more.", "Version 2.0 of C++ came in 2011.", ""):
        assert personal_data.all_spans(clean, weights) == ([], [])


def test_forward_backward_agrees_with_all_segmentations():
    import itertools

    text = "a 1 b@c.d 2"
    window = [m.span() for m in personal_data.TOKEN.finditer(text)]
    spans = personal_data.candidates(text, window)
    r = np.random.default_rng(0)
    out = personal_data.OUTSIDE
    w = (r.normal(0, 0.5, (out, len(next(iter(spans.values()))))), r.normal(0, 0.5, (out + 1, out + 1)))
    ways = []
    for cuts in itertools.product([0, 1], repeat=3):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [4]
        parts = list(zip([0, *ends], ends))
        kinds = [range(out + 1) if j - i == 1 else range(out) for i, j in parts]
        ways += [list(zip(parts, ks)) for ks in itertools.product(*kinds)]
    follows = lambda way: list(zip([out, *[k for _, k in way]], [k for _, k in way]))
    score = np.array([sum(w[0][k] @ spans[p] for p, k in way if k != out) + sum(w[1][f] for f in follows(way)) for way in ways])
    p = np.exp(score - score.max())
    p /= p.sum()
    want = np.zeros_like(w[0]), np.zeros_like(w[1])
    for way, q in zip(ways, p):
        for part, k in way:
            if k != out:
                want[0][k] -= q * spans[part]
        for f in follows(way):
            want[1][f] -= q
    got = personal_data.gradient(spans, [], w, 4)
    want[1][out, out] += 4  # what is observed: nothing but tokens outside
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    gold = [(1, 3, "phone")]
    more = personal_data.gradient(spans, gold, w, 4)
    assert np.allclose((more[0] - got[0])[personal_data.KINDS.index("phone")], spans[1, 3]) and (more[1] - got[1]).sum() == pytest.approx(-1)
    best = ways[int(score.argmax())]
    assert personal_data.decode(text, window, w) == [(personal_data.KINDS[k], *personal_data.trimmed(text, window[i][0], window[j - 1][1])) for (i, j), k in best if k != out]


def card(r, n, good):
    """n digits that pass, or fail, the check of cards, in groups or not; no ISBN."""
    while True:
        x = r.choice("12345678") + "".join(r.choice("0123456789") for _ in range(n - 1))
        if (sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(x[::-1])) % 10 == 0) == good:
            return r.choice(["", " ", "-", "."]).join(re.findall(".{1,4}", x)) if n == 16 else x


def harmless_texts(r):
    """Sentences with what looks like personal data and is none."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    wrap = lambda x: r.choice(["Please note {} for later.", "It was sent to ({}) on Monday.", "{}", "see <{}>, thanks", "das ist {} gewesen"]).format(x)
    for _ in range(60):
        yield wrap("order " + card(r, r.choice([16, 15, 14]), False).replace(" . ", " "))
        yield wrap(r.choice([f"{r.randint(256, 999)}.{d(2)}.{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"section {d(1)}.{d(2)}.{d(2)}"]))
        yield wrap(r.choice([f"+{d(2)}%", f"+{d(4)}", f"{d(3)}-{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"({d(4)})"]))
        yield wrap(r.choice(["@maria", "a @ b", "mail at noon", "user@", "@example"]))
        yield r.choice(["the password is changed every {} days", "a key of {} bits", "token {} of the list", "secret number {}"]).format(d(r.randint(1, 3)))


def private_texts(r):
    """Sentences with personal data, in wordings and forms other than the training's: (kind, span, text)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(["maria", "otto", "j.smith", "Wei_Chen", "support", "info-desk", "anna.k"])
    some = lambda of, n: "".join(r.choice(of) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    wrap = lambda x: r.choice(["Please note {} for later.", "It was sent to ({}) on Monday.", "{}", "see <{}>, thanks", "Contact: {}; then wait", "das ist {} gewesen"]).format(x)
    for _ in range(60):
        x = f"{name()}{r.choice(['', '+news', d(2)])}@{r.choice(['mail', 'corp', 'uni-x'])}.{r.choice(['co.uk', 'de', 'io', 'museum'])}"
        yield "email", x, wrap(x)
        x = ".".join(str(r.randint(0, 255)) for _ in range(4))
        yield "ip", x, wrap(x + r.choice(["", ":8080", "/24"]))
        x = card(r, r.choice([16, 16, 15]), True)
        yield "card", x, wrap("card " + x)
        x = r.choice([f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} ({d(2)}) {d(8)}", f"+{d(12)}"])
        yield "phone", x, wrap(x)
        x = r.choice([some(letters, 28), some(letters + "0123456789", 22), some("0123456789abcdef", 48), some(letters + "0123456789-_", 36), some("abcdefghijklmnopqrstuvwxyz", 16)])
        yield "secret", x, r.choice(["export DB_PASSWORD={}", "my api key: {}, keep it", 'set "clientSecret" : "{}"', "auth_token={}", "the passwd = {} was leaked"]).format(x)


def test_recall_on_other_forms_than_those_of_training():
    weights, found, kinds = personal_data.trained(), {}, {}
    for kind, x, text in private_texts(random.Random(77)):
        kinds[kind] = kinds.get(kind, 0) + 1
        digits = lambda t: re.sub(r"[^A-Za-z0-9]", "", t)
        spans = {(k, digits(text[a:b])) for k, a, b in personal_data.all_spans(text, weights)[1]}
        found[kind] = found.get(kind, 0) + (any(k == kind and len(s) >= 0.9 * len(digits(x)) for k, s in spans))
    assert all(found[k] >= 0.9 * n for k, n in kinds.items()), (found, kinds)


def test_precision_among_texts_that_look_alike():
    weights, right, told = personal_data.trained(), {}, {}
    plain = lambda t: re.sub(r"[^A-Za-z0-9]", "", t)
    for kind, x, text in [*private_texts(random.Random(78)), *((None, "", t) for t in harmless_texts(random.Random(79)))]:
        for k, a, b in personal_data.all_spans(text, weights)[1]:
            told[k] = told.get(k, 0) + 1
            right[k] = right.get(k, 0) + (k == kind and plain(text[a:b]) in plain(x))
    assert set(told) == set(personal_data.KINDS) and all(right[k] >= 0.9 * n for k, n in told.items()), (right, told)


def test_numbers_that_fail_the_check_arent_cards(spark):
    weights = personal_data.trained()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text RLIKE '[0-9]{13}'").collect()
    spans = [r.text[a:b] for r in docs for k, a, b in personal_data.all_spans(r.text, weights)[1] if k == "card"]
    assert spans and all(personal_data.luhn(re.sub("[^0-9]", "", x)) for x in spans)


def test_the_best_segmentation_is_that_of_all():
    import itertools

    r, out = np.random.default_rng(4), personal_data.OUTSIDE
    for text in ("card 4417.7442 a", "+1 22 b@c.d 3", "key = x1 2", "1 2 3 4"):
        window = [m.span() for m in personal_data.TOKEN.finditer(text)]
        spans, n = personal_data.candidates(text, window), len(window)
        for _ in range(5):
            w = (r.normal(0, 1, (out, len(next(iter(spans.values()))))), r.normal(0, 1, (out + 1, out + 1)))
            best = (-np.inf, None)
            for cuts in itertools.product([0, 1], repeat=n - 1):
                ends = [k + 1 for k, c in enumerate(cuts) if c] + [n]
                parts = list(zip([0, *ends], ends))
                if any(p not in spans for p in parts):
                    continue
                for kinds in itertools.product(*[range(out + 1) if j - i == 1 else range(out) for i, j in parts]):
                    score = sum(w[0][k] @ spans[p] for p, k in zip(parts, kinds) if k != out) + sum(w[1][a, b] for a, b in zip([out, *kinds], kinds))
                    best = max(best, (score, list(zip(parts, kinds))), key=lambda x: x[0])
            want = [(personal_data.KINDS[k], *personal_data.trimmed(text, window[i][0], window[j - 1][1])) for (i, j), k in best[1] if k != out]
            assert personal_data.decode(text, window, w) == want


def test_clean_texts_are_left_alone(texts):
    weights = personal_data.trained()
    clean = ["Call 911 at 10:30:00 on 2021-03-04.", "The key to success: patience and a secret of 12 words.", "Keys are 256 bits long: see https://example.org/key/management", "The password policy (section 4.2.1) requires 12 characters.", "ISBN 978-3-16-148410-0 is a book", "between 1,000,000 and 2,500,000 people", "the tokenizer and the keyboard were unremarkable", "On page 12345678 of 99999999 it says 3.14159265358979", "token: a small thing", "ratio = 0.75, step = 12"]
    assert [personal_data.all_spans(t, weights)[1] for t in clean] == [[] for _ in clean]


def test_personal_data_of_messy_rows(messy):
    got = personal_data.personal_data(messy).collect()
    assert sorted([[(x.kind, x.start, x.stop) for x in r.base] for r in got]) == sorted([] if (t or "").startswith("xxx") else base_by_regex(t or "") for _, t, *_ in messy_rows())  # the plain expression is quadratic there


# quality classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    seen = got.merge(labels.toPandas(), on="doc_id")
    seen = seen[seen["held_out"]]
    assert (seen["predicted"] == seen["quality"]).mean() > 0.9


def test_scores_dont_depend_on_held_out_or_unscored_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    scores = lambda d, x: {r.doc_id: r.score for r in quality_classifier.quality_scores(d, x).collect()}
    assert scores(docs, labels) == pytest.approx(scores(other, turned), abs=1e-6)


def test_scores_agree_with_a_model_fitted_in_one_place(spark):
    """The sums over all unlabelled texts and the scores, against numpy over the whole small table."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    measured = quality_classifier.feature_table(docs.select("doc_id", "text"))
    model = quality_classifier.train(measured, labels)
    known = {r.doc_id for r in labels.collect() if r.quality is not None}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    unl = np.array([quality_classifier.features(t) for i, t in texts.items() if i not in known and zlib.crc32(str(i).encode()) % 4 != 2])
    assert np.allclose(model["mean"], unl.mean(0)) and np.allclose(model["scale"], np.maximum(unl.std(0), 1e-3))
    want = {i: float(quality_classifier.score(model, np.array([quality_classifier.features(t)]))[0]) for i, t in texts.items()}
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_prior_and_risk_on_known_mixture():
    r = np.random.default_rng(0)
    pos, unl = r.normal(0, 1, (2000, 3)), np.r_[r.normal(0, 1, (2100, 3)), r.normal(4, 1, (900, 3))]
    x = np.c_[unl, np.ones(len(unl))]
    prior = quality_classifier.class_prior(pos, lambda ws: [quality_classifier.newton_sums(x, 0.0, np.full(len(x), 1 / len(x)), w) for w in ws])
    assert abs(prior - 0.7) < 0.1  # a linear classifier sees the plateau a little too low
    model = quality_classifier.fit_pu(pos, unl, prior) | {"mean": np.zeros(3), "scale": np.ones(3), "slope": 1.0, "shift": 0.0}
    s = quality_classifier.score(model, np.r_[r.normal(0, 1, (500, 3)), r.normal(4, 1, (500, 3))])
    assert (s[:500] > 0.5).mean() > 0.95 and (s[500:] < 0.5).mean() > 0.95


def test_gradient_is_that_of_the_risk():
    r = np.random.default_rng(5)
    x, is_pos = r.normal(0, 1, (40, 3)), np.arange(40) < 15
    theta = [r.normal(0, 1, (3, 4)), r.normal(0, 1, 4), r.normal(0, 1, 4), r.normal(0, 1, 1)]
    for prior in (0.3, 0.95):
        risk, grads = quality_classifier.risk_and_gradient(theta, x, is_pos, prior)
        s = 1 / (1 + np.exp(-(np.tanh(x @ theta[0] + theta[1]) @ theta[2] + theta[3])))
        negative = s[~is_pos].mean() - prior * s[is_pos].mean()
        assert risk == pytest.approx(prior * (1 - s[is_pos]).mean() + max(0, negative))
        for k, t in enumerate(theta):
            for at in np.ndindex(t.shape):
                moved = [u.copy() for u in theta]
                moved[k][at] += 1e-6
                s2 = 1 / (1 + np.exp(-(np.tanh(x @ moved[0] + moved[1]) @ moved[2] + moved[3])))
                n2 = s2[~is_pos].mean() - prior * s2[is_pos].mean()
                change = (prior * (1 - s2[is_pos]).mean() + n2) - (prior * (1 - s[is_pos]).mean() + negative) if negative >= 0 else negative - n2
                assert grads[k][at] == pytest.approx(change / 1e-6, abs=1e-4)


def test_classifier_of_messy_rows_and_few_labels(spark, messy):
    rows = len(messy_rows())
    none = spark.createDataFrame([(None, 1, 0), (0, None, 0), (33, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(messy, none).toPandas()
    assert len(got) == rows and set(got["score"]) == {0.5}
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)] + [(42, 0, 0), (43, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(messy, labels).toPandas()
    assert len(got) == rows and got["score"].between(0, 1).all()
    kept = quality_classifier.keep_good(messy, labels)
    assert kept.columns == messy.columns and kept.count() == (got["predicted"] == 1).sum()
    assert isinstance(got, pd.DataFrame)
