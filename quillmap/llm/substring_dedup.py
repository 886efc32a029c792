"""Repeated passages by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import as_text, in_slices, read_documents, stored

#: A boundary stands where the gear hash of the last 8 bytes is the least within some stretch of so many bytes; so chunks have half of that on average. Monotonous text is cut after so many bytes each.
STRETCH = 80
#: Bytes that a passage can go on beside its repeated chunks: a stretch, and what its first hash looks back.
REACH = STRETCH + 8
#: Words that a repeated passage has at least.
RUN_WORDS = 50

#: Odd multiplier that joins the digests of two neighbouring chunks.
PAIR = np.uint64(0x9E3779B97F4A7C15)
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
#: Lower case and one kind of white space, byte for byte, so places stay.
FOLD = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(FOLD)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some bytes; the last is the number of bytes.

    hash(i) = sum of GEAR[byte(i - j)] << j over 8 bytes; by doubling, it takes one pass per power
    of two. The least of every stretch comes from running minima to both sides within blocks. Of
    equal hashes that follow each other, as in monotonous text, the first counts alone.
    """
    n = len(data)
    h = GEAR[data]
    for k in (1, 2, 4):
        h[k:] += h[:-k] << np.uint32(k)
    h >>= np.uint32(3)  # the lowest bits have seen the last bytes only
    ends = np.zeros(0, np.int64)
    if n >= STRETCH:
        blocks = -(-n // STRETCH)
        key = np.full(blocks * STRETCH, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        grid = key.reshape(blocks, STRETCH)
        upto = np.minimum.accumulate(grid, 1).ravel()
        onward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(onward[: n - STRETCH + 1], upto[STRETCH - 1 : n])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        ends = at[np.r_[True, h[at[1:]] != h[at[:-1]]]] + 1
    ends = np.r_[0, ends[ends < n], n]
    gaps = np.flatnonzero(np.diff(ends) > STRETCH)
    if len(gaps):
        ends = np.unique(np.r_[ends, np.concatenate([np.arange(ends[g], ends[g + 1], STRETCH) for g in gaps])])
    return ends[1:]


def digests_of(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Of each chunk together with the chunk after it."""
    import xxhash

    at = ends.tolist()
    chunks = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *at], at)], np.uint64)
    return (chunks[:-1] * PAIR + chunks[1:]).view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)), pa.array(flat, kind))


def digest_table(docs: DataFrame) -> DataFrame:
    """docs: (doc, doc_id, text). One row per document: doc, doc_id, digests."""

    @in_slices
    def cut(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                raw = folded(text)
                found.append(digests_of(raw, boundaries(np.frombuffer(raw, np.uint8))) if raw else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), lists(found, pa.int64())], names=["doc", "doc_id", "digests"])

    return docs.mapInArrow(cut, "doc long, doc_id long, digests array<long>")


RUNS = {"run": "int", "keep_id": "long", "first": "long", "last": "long", "start": "long", "stop": "long", "from_word": "long", "to_word": "long"}
SIDES = {f"{side}_{c}": "array<long>" for side in ("left", "right") for c in ("hash", "at", "word")}
WAYS = {"anchor": "array<long>", "way": "array<long>"}


class Text:
    """A text's chunks and words, and how it goes on beside a chunk pair.

    ways(k, left) are word starts before the pair's first chunk, from the nearest on, or word ends after
    its second one, with hashes of the text between. They go REACH bytes from the next boundary: if two
    texts agree farther, a whole stretch that they share has a boundary there, and the chunks up to it
    are repeated too, unless that stretch begins where the texts differ and gives one of them a boundary
    more beside the pair.
    """

    def __init__(self, text: str):
        self.raw = folded(text)
        data = np.frombuffer(self.raw, np.uint8)
        self.ends = boundaries(data)
        self.begins = np.r_[0, self.ends[:-1]]
        self.pairs = digests_of(self.raw, self.ends)
        blank = data == 32
        self.starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        self.stops = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        self.chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]

    def ways(self, k: int, left: bool) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        digest = lambda a, b: xxhash.xxh3_64_intdigest(self.raw[a:b])
        if left:
            b = int(self.begins[k])
            low = int(self.begins[max(0, k - 1)]) - REACH
            words = np.arange(np.searchsorted(self.starts, low), np.searchsorted(self.starts, b))[::-1]
            hashes = [digest(a, b) for a in self.starts[words].tolist()]
        else:
            e = int(self.ends[k + 1])
            high = int(self.ends[min(len(self.ends) - 1, k + 2)]) + REACH
            words = np.arange(np.searchsorted(self.stops, e, side="right"), np.searchsorted(self.stops, high, side="right"))
            hashes = [digest(e, z) for z in self.stops[words].tolist()]
        return words, np.array(hashes, np.uint64).view(np.int64)

    def run(self, k0: int, k1: int) -> tuple:
        """first, last, start, stop, from_word, to_word: the digests at both ends, and the whole words of the chunks."""
        b, e = int(self.begins[k0]), int(self.ends[k1 + 1])
        w0, w1 = int(np.searchsorted(self.starts, b)), int(np.searchsorted(self.stops, e, side="right"))
        whole = (int(self.chars[self.starts[w0]]), int(self.chars[self.stops[w1 - 1]])) if w1 > w0 else (int(self.chars[b]), int(self.chars[b]))
        return int(self.pairs[k0]), ~int(self.pairs[k1]), *whole, w0, max(w0, w1)


def runs_in(text: str, hits: list[tuple], run_words: int) -> list[tuple]:
    """hits: (k, keep_id, left, right) of repeated chunk pairs, left or right if a run of any document begins or ends with that pair. One tuple, as RUNS, SIDES and WAYS name its parts, for each unbroken run of pairs.

    The sides of a run have the ways beside it and where they lead, in characters and in words, if it can
    come to run_words words. anchor and way, with the first run, have the ways beside all pairs marked
    left or right; the complement of a digest stands for its right side.
    """
    t = Text(text)
    k = np.array([h[0] for h in hits])
    anchors, ways = [], []
    for n, _, left, right in hits:
        for left_side in [True] * bool(left) + [False] * bool(right):
            found = t.ways(n, left_side)[1]
            anchors.append(np.full(len(found), int(t.pairs[n]) if left_side else ~int(t.pairs[n]), np.int64))
            ways.append(found)
    beside = (np.concatenate(anchors), np.concatenate(ways)) if ways else (NONE, NONE)
    out = []
    for run, at in enumerate(np.split(np.arange(len(k)), np.flatnonzero(np.diff(k) > 1) + 1)):
        k0, k1 = int(k[at[0]]), int(k[at[-1]])
        keep = min((hits[a][1] for a in at if hits[a][1] is not None), default=None)
        whole = t.run(k0, k1)
        (left, left_hash), (right, right_hash) = t.ways(k0, True), t.ways(k1, False)
        sides = [left_hash, t.chars[t.starts[left]], left, right_hash, t.chars[t.stops[right]], right + 1]
        able = whole[5] - whole[4] + len(left) + len(right) >= run_words
        if able or not run:
            out.append((run, keep, *whole, *(sides if able else [NONE] * 6), *(beside if not run else (NONE, NONE))))
    return out


NONE = np.zeros(0, np.int64)


def run_table(hits: DataFrame, run_words: int) -> DataFrame:
    """hits: (doc, doc_id, text, hits), hits being an array of (k, keep_id, l, r); see runs_in()."""
    names = ["doc", "doc_id", *RUNS, *SIDES, *WAYS]
    n_plain = 2 + len(RUNS)

    @in_slices
    def find(batches):
        for batch in batches:
            rows = []
            for doc, doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "doc_id", "text", "hits"))):
                found = runs_in(text, sorted(((h["k"], h["keep_id"], h["l"], h["r"]) for h in own), key=lambda h: h[0]), run_words)
                rows += [(doc, doc_id, *r) for r in found]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            plain = [pa.array(c, pa.int32() if n == "run" else pa.int64()) for n, c in zip(names, columns[:n_plain])]
            yield pa.RecordBatch.from_arrays([*plain, *[lists(list(c), pa.int64()) for c in columns[n_plain:]]], names=names)

    return hits.mapInArrow(find, ", ".join(f"{c} {t}" for c, t in {"doc": "long", "doc_id": "long", **RUNS, **SIDES, **WAYS}.items()))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per passage that stands in several documents: doc_id, start, length (characters), n_words, keep_id, is_copy.

    Texts are folded (ASCII case, white space) and cut where a gear hash of the last few bytes says
    so, so an insertion moves the boundaries near it only. Chunks are grouped by the digest of
    themselves with the chunk after them, since one short chunk alone may recur by chance; a digest
    seen in several documents marks its chunks as repeated, and neighbouring ones of a document form
    a run. A run is then extended by whole words to both sides as far as another document goes on
    alike beside the chunks at its end, wherever these stand there, and reported if it has run_words
    words. A passage of that many words and of 8 + 3 * STRETCH bytes always has such chunks. keep_id
    is the smallest doc_id that has any of the run's chunks; is_copy tells whether that is another
    document.

    Digests, and the ways a run may go on, are counted by partial aggregation, so a passage that a
    third of all documents share never meets in one task; chunks learn their digest's fate by joins
    whose large side AQE can split. Documents without repeated passages have no row.

    Defined cases: null, empty and short texts have no chunks to compare; a document is a doc_id with a
    text, so rows repeated with both are one, other rows of one doc_id are further documents, and rows
    without doc_id are told apart by their texts, with keep_id null where no doc_id has the passage;
    of runs that reach equally far the one way is reported, and of documents that have a passage the smallest
    doc_id is its keep_id; very long texts are read whole; an empty table gives no rows; further columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    source = source.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    several = lambda df, keys, *more: df.groupBy(*keys).agg(F.min("doc").alias("one"), F.max("doc").alias("other"), *more).filter("one <> other")
    with Steps(docs.sparkSession) as steps:
        with Steps(docs.sparkSession) as before:
            table = before.keep(digest_table(source))
            shared = several(table.select("doc", "doc_id", F.explode("digests").alias("digest")), ["digest"], F.min("doc_id").alias("keep_id")).select("digest", "keep_id")
            hits = steps.keep(table.select("doc", F.posexplode("digests").alias("k", "digest")).join(shared, "digest"))
        place = Window.partitionBy("doc").orderBy("k")  # of one text; its repeated rows count once
        edges = hits.withColumn("run", F.col("k") - F.dense_rank().over(place)).groupBy("doc", "run").agg(F.min_by("digest", "k").alias("first"), F.max_by("digest", "k").alias("last"))
        anchors = lambda side: steps.keep(edges.select(F.col(side).alias("digest")).distinct())
        marked = hits.join(anchors("first").withColumn("l", F.lit(True)), "digest", "left").join(anchors("last").withColumn("r", F.lit(True)), "digest", "left")
        per_doc = marked.groupBy("doc").agg(F.collect_set(F.struct("k", "keep_id", "l", "r")).alias("hits"))
        runs = stored(run_table(source.join(per_doc, "doc"), run_words), "runs")

    ways = several(runs.select("doc", F.explode(F.arrays_zip("anchor", "way")).alias("z")).select("doc", "z.*"), ["anchor", "way"]).select("anchor", "way")
    side = lambda name, anchor: runs.select("doc", "run", F.lit(name).alias("side"), F.col(anchor).alias("anchor"), F.posexplode(f"{name}_hash").alias("j", "way"))
    gone_on = side("left", "first").unionByName(side("right", "last")).join(ways, ["anchor", "way"], "left_semi").groupBy("doc", "run")
    reach = gone_on.agg(F.max(F.when(F.col("side") == "left", F.col("j"))).alias("l"), F.max(F.when(F.col("side") == "right", F.col("j"))).alias("r"))
    wide = runs.join(reach, ["doc", "run"], "left")
    end = lambda c, side, j: F.coalesce(F.get(side, F.col(j)), F.col(c)).alias(c)
    wide = wide.select("doc", "run", "doc_id", "keep_id", end("start", "left_at", "l"), end("from_word", "left_word", "l"), end("stop", "right_at", "r"), end("to_word", "right_word", "r"))
    passages = wide.withColumn("n_words", F.col("to_word") - F.col("from_word")).filter(F.col("n_words") >= run_words).dropDuplicates(["doc", "run"])
    return passages.select("doc_id", "start", (F.col("stop") - F.col("start")).alias("length"), "n_words", "keep_id", (~F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("is_copy"))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_documents(spark, sf_dir))


SQL = None
