"""N-gram Jaccard join: near duplicates by word shingles, found with signature trees."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import as_rows, as_text, checkpoint, in_slices, read_documents, stored
from .components import components
from .signature_tree import bitmap, join_group, may_join, width_for

#: Shingles and documents that one task takes from a cluster at a time; larger clusters are split into blocks.
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 8192
#: Documents of a split cluster, about, that every block of it also gets.
PIVOTS = 64
#: Times that segments are drawn anew while some are empty.
DRAWS = 24

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = (s + h[j : len(h) - k + 1 + j]) * C
        s ^= s >> np.uint64(29)
    return np.unique(mix(s))


def class_starts(p: int, most: int) -> np.ndarray:
    """First sizes of size classes, so that a set's partners of p percent are in its own class or a neighbouring one."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // p + 1)
    return np.array(starts)


def segment_keys(u: np.ndarray, p: int) -> np.ndarray:
    """Keys of which two sets with 100 * overlap >= p * union have one in common.

    Such sets differ in at most d = (100 - p) / (100 + p) * (their sizes together) elements, so of
    d + 1 + e segments of the hash space at least 1 + e hold the same elements in both. Empty
    segments make no keys; if one of the two sets has at most e of them, a segment that both hold
    is not empty. A set with more of them makes further keys with a new draw of the segments, and
    so on; the pair meets in the first draw in which either has few enough. The number of segments
    depends on the class of sizes; a set makes keys for its class and the next.
    """
    starts = class_starts(p, len(u))
    own = int(np.searchsorted(starts, len(u), side="right")) - 1
    keys = []
    for c in (own, own + 1):
        m, empty = segments(int(starts[c]), p)
        v = u
        for draw in range(DRAWS + 1):
            if draw == DRAWS:
                keys.append(mix(np.array([c * 1000 + 999], np.uint64)))
                break
            at = ((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums = np.add.reduceat(mix(v), begins)
            keys.append(mix(sums + at[begins] * A + np.uint64((c * 1000 + draw) * int(C) % 2**64)))
            if m - len(begins) <= empty:
                break
            v = np.sort(mix(v + B))
    return np.concatenate(keys)


@functools.cache
def segments(first: int, p: int) -> tuple[int, int]:
    """Number of segments for the class of sizes that begins with `first`, and how many of them may be empty: as many as its smallest sets leave, and two deviations more."""
    largest, least = first * 100 // p, first * p // 100
    d = 2 * largest * (100 - p) // (100 + p)
    empty = 0
    for _ in range(5 if d else 0):
        mean = (d + 1 + empty) * math.exp(-least / (d + 1 + empty))
        empty = math.ceil(mean + 2 * math.sqrt(mean))
    return d + 1 + empty, empty


def signature_table(docs: DataFrame, k: int) -> DataFrame:
    """docs: (doc_id, text_hash, text). Per row doc_id, text_hash, n_shingles, set_hash (null without words) and marks, the set's bitmap."""

    @in_slices
    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, k, hashes) for text in batch.column("text").to_pylist()]
            names = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in sets]
            marks = [bitmap(u, width_for(len(u))).tobytes() for u in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(u) for u in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_hash", "marks"])

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_hash binary, marks binary")


def key_table(nodes: DataFrame, k: int, p: int) -> DataFrame:
    """nodes: (node, text). Rows (node, key)."""

    @in_slices(rows=200)
    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, k, hashes) for text in batch.column("text").to_pylist()]
            keys = [segment_keys(u, p).view(np.int64) if len(u) else np.zeros(0, np.int64) for u in sets]
            of = np.repeat(batch.column("node").to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate(keys), pa.int64())], names=["node", "key"])

    return nodes.mapInArrow(sign, "node long, key long")


def buckets_of(keys: DataFrame, steps: Steps) -> DataFrame:
    """Rows (bucket, n, node) of keys that several nodes have. Keys that the same nodes have make one bucket; n is its size.

    Keys are counted first, by partial aggregation, and nearly all have one node; only the others'
    rows are looked at again. A key of many nodes never meets in one task: counts and minima combine
    before the shuffle, and rows find theirs by joins that AQE can split, or that are broadcast if
    the files are small.
    """
    frequent = steps.keep(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    rows = steps.keep(keys.join(frequent, "key", "left_semi"))
    sizes = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"))
    return rows.join(sizes, "key").select(F.xxhash64("pivot", "n", "members").alias("bucket"), "n", "node").distinct()


def bucket_links(buckets: DataFrame, signed: DataFrame, p: int) -> DataFrame:
    """Links (a, b) among nodes whose bitmaps and sizes allow a link: per bucket a spanning forest of them, found by a signature tree.

    signed: (node, n_shingles, marks). A bucket above BLOCK_DOCS is dealt into parts, and each pair
    of parts meets in a task of its own.
    """

    def links(batches):
        key, rows = None, []

        def done():
            ids, sizes, maps = zip(*rows)
            labels = may_join(np.array(ids, np.int64), np.array(sizes, np.int64), maps, p)
            return [(i, int(x)) for i, x in zip(ids, labels) if i != x]

        def frame(found):
            return pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found]}, dtype="int64")

        for batch in batches:
            found = []
            for *at, node, n, marks in zip(batch["bucket"], batch["low"], batch["high"], batch["node"], batch["n_shingles"], batch["marks"]):
                if at != key:
                    if len(rows) > 1:
                        found += done()
                    key, rows = at, []
                rows.append((node, n, marks))
            yield frame(found)
        if len(rows) > 1:
            yield frame(done())

    parts = F.when(F.col("n") > BLOCK_DOCS, F.ceil(F.col("n") * 2 / BLOCK_DOCS)).otherwise(1).cast("long")
    dealt = buckets.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = dealt.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node").join(signed, "node")
    return placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node").mapInPandas(links, "a long, b long").distinct()


def tree_links(blocks: DataFrame, k: int, p: int) -> DataFrame:
    """blocks: (cluster, block, node, label, text), all rows of a block in one partition and together. Links (a, b) that join each node's label to the smallest it reaches."""

    def links(batches):
        hashes = WordHashes()
        key, rows = None, []

        def done():
            sets = [shingles(t, k, hashes) for _, _, t in rows]
            labels = join_group(np.array([r[0] for r in rows]), sets, p, np.array([r[1] for r in rows]))
            return [(r[1], int(x)) for r, x in zip(rows, labels) if r[1] != x]

        def frame(found):
            return pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found]}, dtype="int64")

        for batch in batches:
            found = []
            for c, b, node, label, text in zip(batch["cluster"], batch["block"], batch["node"], batch["label"], batch["text"]):
                if (c, b) != key:
                    if len(rows) > 1:
                        found += done()
                    key, rows = (c, b), []
                rows.append((node, label, text))
            yield frame(found)
        if len(rows) > 1:
            yield frame(done())

    placed = blocks.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "node")
    return placed.mapInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, keep_keys: bool = True) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id (the smallest doc_id that links reach).

    Documents link when 100 * overlap >= percent * union of their sets of k-word shingles (ASCII
    case folded). The steps, none of which drops a pair that links:

    1. Rows with equal sets become one node, so copies cost nothing later.
    2. Each node makes segment keys (see segment_keys); nodes that link have one in common. The
       nodes of a key form a bucket; a key's rows are streamed, not gathered.
    3. A bucket's bitmaps, without texts, build a signature tree, which is traversed against
       itself; node pairs are pruned when their bitmaps and sizes allow no sufficient overlap, or
       when all their sets are joined already. The components of what remains are the clusters in
       which all links lie.
    4. A cluster's texts meet in one task, which builds a tree of them in the same way and compares
       sets exactly in the leaves.
    5. A cluster above BLOCK_SHINGLES or BLOCK_DOCS is split into blocks that share some pivots.
       What isn't joined to its largest component after that is compared with every block. So
       a large group of near copies costs as its size, and only what stays apart costs more.

    keep_keys writes the segment keys, which are read twice; without it they are made twice, which takes
    more time and less disk. They are the more, the smaller percent is.

    Sets are of 64-bit hashes. Defined cases: null and empty texts have no shingles and link with
    nothing; with fewer than k words the whole sequence is one shingle; rows without doc_id link
    with nothing and have a null component; rows with one doc_id are judged by their own texts, and equal
    sets link whatever the order of rows, so there are no ties; very long texts give whole sets; repeated rows
    have one component; an empty table gives no rows; further columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    table = checkpoint(signature_table(hashed, k))
    usable = table.filter(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    with Steps(docs.sparkSession) as steps:
        with_text = lambda df: source.withColumnRenamed("doc_id", "node").join(steps.keep(df), "node")
        names = usable.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
        copies = steps.keep(usable.select("doc_id", "text_hash", "set_hash").join(names, "set_hash").filter("doc_id <> node").select("doc_id", "text_hash").distinct())
        first = hashed.filter("doc_id IS NOT NULL").join(copies, ["doc_id", "text_hash"], "left_anti")
        with Steps(docs.sparkSession) as before:
            keys = key_table(first.select(F.col("doc_id").alias("node"), "text"), k, percent)
            keys = before.keep(keys) if keep_keys else keys
            buckets = steps.keep(buckets_of(keys, before))
        signed = usable.select(F.col("doc_id").alias("node"), "n_shingles", "marks")
        edges = steps.keep(bucket_links(buckets, signed, percent))
        clusters = components(edges)

        sized = clusters.join(usable.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.sum("n_shingles").alias("n")), "node")
        weights = sized.groupBy("component").agg(F.sum("n").alias("n_all"), F.count("*").alias("docs"))
        split = F.ceil(F.greatest(F.col("n_all") / BLOCK_SHINGLES, F.col("docs") / BLOCK_DOCS)).cast("long")
        weights = steps.keep(weights.select("component", split.alias("blocks"), F.ceil(F.col("docs") / PIVOTS).cast("long").alias("every")))
        members = steps.keep(clusters.join(weights, "component"))
        placed = members.select("node", F.col("component").alias("cluster"), F.explode(F.when((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node"), F.col("every")) == 0), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))))).alias("block"))
        links = steps.keep(tree_links(with_text(placed.withColumn("label", F.col("node"))), k, percent))
        joined = components(links)
        if not weights.filter("blocks > 1").isEmpty():
            links = links.unionByName(across_blocks(members.filter("blocks > 1"), joined, with_text, k, percent, steps))
            joined = components(links)

    names = usable.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    named = names.join(joined, "node", "left").select(F.col("set_hash").alias("of"), F.coalesce("component", "node").alias("component_id"))
    alone = F.when(F.col("set_hash").isNull(), F.col("doc_id"))
    out = table.select("doc_id", "text_hash", "n_shingles", "set_hash").join(named, F.col("set_hash") == F.col("of"), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest doc_id of their group. Groups are those of near_duplicates, for the defined cases too: texts without words and rows without doc_id stay, and so do repeated rows of a doc_id that stays. Any names of further columns may be given."""
    found = near_duplicates(docs, id_col, text_col, k, percent, keep_keys=False)
    gone = stored(found.filter("component_id <> doc_id").select("doc_id", "text_hash").distinct(), "near-copies")
    rows = as_rows(docs).withColumns({"doc_id": F.col("row")[id_col].cast("long"), "text_hash": F.xxhash64(as_text(F.col("row")[text_col]))})
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select("row.*")


def across_blocks(members: DataFrame, joined: DataFrame, with_text, k: int, p: int, steps: Steps) -> DataFrame:
    """Further links in split clusters: what is outside of a cluster's largest component, in blocks of its own, against every block."""
    state = steps.keep(members.join(joined.withColumnRenamed("component", "label"), "node", "left").select("node", F.col("component").alias("cluster"), "blocks", F.coalesce("label", "node").alias("label")))
    largest = state.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    state = state.join(largest, "cluster")
    rest = state.filter("label <> largest")
    parts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    name = lambda r, b: F.concat_ws(":", r, b)
    asking = rest.join(parts, "cluster").select("cluster", "node", "label", part.alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    asked = state.join(parts, "cluster").select("cluster", "node", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("r"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("b"))
    blocks = asking.unionByName(asked).distinct().select("cluster", "node", "label", name("r", "b").alias("block"))
    return steps.keep(tree_links(with_text(blocks), k, p))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), k=3, percent=90)


SQL = None
