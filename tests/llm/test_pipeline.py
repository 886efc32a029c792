import hashlib
import pathlib
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillmap.llm import mixing, personal_data, quality_classifier
from quillmap.llm import queries as llm_queries

from .conftest import messy_rows
from .test_dedup_and_join import linked_components, shingle_sets

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark, small):
    docs, n = small, small.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == small.columns, name
        m = docs.count()
        assert m > 0 and (name == "mixing" or m <= n), name
        n = m


def test_stages_take_messy_rows_and_none(spark, messy, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).isEmpty(), name
        out = stage(spark, messy, SMALL)
        assert name == "packing" or out.columns == messy.columns
        assert out.count() <= (10**4 if name in ("packing", "mixing") else len(messy_rows()))


def test_run_leaves_no_copies_before_mixing(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("doc_id", "start").count().filter("count > 2").isEmpty()
    again = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(out.select(*key).collect()) == sorted(again.select(*key).collect())
    kept = [name for at in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).glob("corpus-*") for name in at.iterdir()]
    assert kept == []


def test_run_applies_each_stage_to_all_that_the_one_before_kept(spark, small):
    """Each stage's decisions, taken by the operators' plain results, in Python."""
    docs = {r.doc_id: r for r in small.collect()}
    scores = quality_classifier.quality_scores(small, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    left = {r.doc_id for r in scores if r.predicted}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text or ""), i)
    left = set(first.values())
    label = linked_components(shingle_sets({i: docs[i].text for i in left}, 5), 80)
    left = {i for i in left if label[i] == i}
    mixed = mixing.mix_sources(small.filter(small.doc_id.isin([*left]))).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for r in mixed:
        ids = [*encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, tuple(ids[k : k + 2048])) for k in range(0, len(ids), 2048)] * r.copies
    got = [(r.doc_id, r.start, tuple(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and len(left) > 50


def test_packing_gives_ids_and_their_digests(spark, small):
    rows = corpus_pipeline.packing(spark, small, SMALL).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 for r in rows)


def test_one_query_for_each_operator():
    names = list(llm_queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))


def test_queries_return_their_columns_for_every_document(spark, small, texts):
    columns = {
        "op2": "doc_id held_out score predicted", "op3": "doc_id n_shingles component_id", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op6": "doc_id n_words n_base first_word last_word base_labels labels score", "op7": "doc_id size source_size target taken", "op8": "doc_id size text_crc32 law shard slot grown_shard",
        "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10": "doc_id keep_id group_size kept text_sha256",
        "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    }
    for name, query in llm_queries.queries().items():
        op = name.split("_")[0]
        if op in columns:
            rows = query(spark, SMALL).collect()
            assert sorted(r.doc_id for r in rows) == sorted(texts), name
            assert set(columns[op].split()) <= set(rows[0].asDict()), name
    rows = llm_queries.queries()["op8_sharding"](spark, SMALL).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_op1_gives_the_digests_of_the_unaltered_tokenizer(spark, texts):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for i, t in texts.items():
        ids = [*encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k, len(x := ids[k : k + 2048]), zlib.crc32(b"".join(j.to_bytes(4, "little") for j in x)), len(ids)) for k in range(0, len(ids), 2048)]
    got = llm_queries.queries()["op1_packing"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.collect()) == sorted(want)


def test_op9_gives_the_digest_and_list_of_spans(spark, texts):
    weights = personal_data.trained()
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in llm_queries.queries()["op9_personal_data"](spark, SMALL).collect():
        base, spans = personal_data.all_spans(texts[r.doc_id], weights)
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and r.spans == told(spans) and r.n_spans == len(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in personal_data.BASE_KINDS]


def test_threads_keep_what_they_store(spark, small):
    """What one thread's block removes leaves the frames of another alone, and folders of blocks within blocks go with their own."""
    import threading

    from quillmap.llm import common, exact_dedup

    there = lambda: {p.name for p in pathlib.Path(common.shared_folder(spark).removeprefix("file://")).iterdir()}
    out, ready, done = {}, threading.Event(), threading.Event()

    def other():
        with common.owned():
            out["rows"] = exact_dedup.exact_dedup(small, digest_all=True)
            ready.set()
            done.wait(120)
            out["n"] = out["rows"].count()

    before = there()
    thread = threading.Thread(target=other)
    with common.owned():
        mine = exact_dedup.exact_dedup(small)
        thread.start()
        assert ready.wait(120)
        with common.owned():
            exact_dedup.exact_dedup(small).count()
        assert mine.count() == small.count()
    done.set()
    thread.join()
    assert out["n"] == small.count()
    assert {p for p in there() - before if p.startswith(("groups", "prefixes", "steps"))} == set()
