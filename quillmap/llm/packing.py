"""Packing of tokenised documents into fixed windows: non-negative least squares over length patterns."""

from __future__ import annotations

import base64
import functools
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import as_text, checkpoint, in_slices, read_documents, stored

#: Tokens per sequence, and the id that ends each document.
WINDOW, END = 2048, 1
#: Most pieces in a pattern that the solver counts; deeper ones only arise from residuals.
DEPTH = 4
#: Multiplicative steps of the solver, over all patterns and over the chosen ones.
BROAD, STEPS = 30, 300
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids", "task", "rank"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def tokenizer(path: str):
    """Byte-level BPE from a file of ranks; it gives the ids of the vocabulary's JSON form, special strings being ordinary text. For all texts see encoder()."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(path: str):
    """text -> ids (array of uint32) of the vocabulary's JSON form, which lies beside the file of ranks, in the default setting of `tokenizers`.

    The ranks give the same ids sooner, since every entry of the vocabulary is what its merges make of
    its bytes. What they don't know goes to the JSON form: texts with a special string, which is one
    id there, and texts on whose long runs of white space the pattern exceeds its stack in `tiktoken`.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(os.path.splitext(path)[0] + ".json")
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    fast = tokenizer(path).encode_to_numpy

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def piece_table(docs: DataFrame, path: str, window: int) -> DataFrame:
    """docs: (doc_id, text). Full windows of each document and what is left: (doc_id, start, length, doc_tokens, ids, task, rank).

    task is the number of the task that cut the piece, rank its place among that task's pieces of its length.
    """

    @in_slices
    def cut(batches):
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            texts = [np.append(encode(t), np.uint32(END)) for t in batch.column("text").to_pylist()]
            tokens = np.array([len(t) for t in texts], np.int64)
            pieces = -(-tokens // window)
            of = np.repeat(np.arange(len(texts)), pieces)
            start = (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]) * window
            length = np.minimum(window, tokens[of] - start)
            rank = []
            for n in length.tolist():
                rank.append(seen[n])
                seen[n] += 1
            flat = np.concatenate(texts).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(flat))
            doc_id = batch.column("doc_id").take(pa.array(of))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(length), pa.array(tokens[of]), ids, pa.array(np.full(len(of), task, np.int32)), pa.array(rank, pa.int64())], names=COLUMNS)

    return docs.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids array<int>, task int, rank long")


def patterns(lengths: np.ndarray, window: int) -> np.ndarray:
    """Combinations of present lengths that fill the window exactly, zeros where shorter: all pairs and triples, and of the fours, whose number has no use, one length with equal or graded parts of the rest."""
    lengths = lengths[(lengths > 0) & (lengths < window)]
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = []
    for a in [0, *lengths.tolist()]:  # the smallest of three, or none
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[have[window - a - b]]
        found.append(np.c_[window - a - b, b, np.full(len(b), a), np.zeros(len(b), np.int64)])
    for a in lengths.tolist():
        for share in (1, 2, 4):  # the second part is so many times the others
            other = (window - a) // (share + 2)
            combo = [a, window - a - 2 * other, other, other]
            if other and have[combo].all():
                found.append(np.array([sorted(combo, reverse=True)]))
    return np.unique(np.concatenate(found), axis=0).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A having the patterns as columns.

    Multiplicative steps over all patterns first. As there are many more patterns than lengths, an
    optimum needs no more patterns than lengths; so the ones with the largest counts and each length's
    best are solved again by themselves, which gives counts that survive rounding.
    """
    x = _multiplicative(combos, histogram, BROAD)
    order = np.argsort(-x, kind="stable")
    chosen = np.zeros(len(combos), bool)
    chosen[order[: 2 * len(histogram)]] = True
    for place in range(DEPTH):  # the first in order that has a length is its best
        chosen[order[np.unique(combos[order, place], return_index=True)[1]]] = True
    out = np.zeros(len(combos))
    out[chosen] = _multiplicative(combos[chosen], histogram, STEPS)
    return out


def _multiplicative(combos: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    weight = (combos > 0).astype(float)
    h = histogram.astype(float)
    h[0] = 0
    pull = (h[combos] * weight).sum(1)
    x = pull / np.maximum(pull.sum(), 1) * h.sum() / 2
    for _ in range(steps):
        used = np.bincount(combos.ravel(), (x[:, None] * weight).ravel(), len(h))
        x *= pull / np.maximum((used[combos] * weight).sum(1), 1e-12)
    return x


def plan_sequences(histogram: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of every kind of sequence, using each piece of the histogram once.

    The solver's counts are rounded down and limited to what is there; what remains is packed
    greedily, the largest length that fits first, as many times at once as the remains allow.
    The work depends on the window, not on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    plan = []

    def use(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((times, combo))
            for n in combo:
                left[n] -= times

    def fits(combo: tuple[int, ...]) -> int:
        return min(int(left[n]) // combo.count(n) for n in set(combo))

    combos = patterns(np.flatnonzero(left[:window]), window)
    if len(combos):
        x = np.floor(solve(combos, left)).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            combo = tuple(int(n) for n in combos[p] if n)
            use(combo, min(int(x[p]), fits(combo)))
    while (present := np.flatnonzero(left)).size:
        combo, room, taken = [], window, {}
        while room:
            open_ = present[: np.searchsorted(present, room, side="right")]
            n = next((int(v) for v in open_[::-1] if left[v] > taken.get(int(v), 0)), 0)
            if not n:
                break
            combo.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        use(tuple(combo), fits(tuple(combo)))
    return plan


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan turned round: for each length, from which rank on its pieces go to which sequences, and where in them."""
    rows, first = [], 0
    for times, combo in plan:
        at = 0
        for n in combo:
            rows.append((n, times, first, at))
            at += n
        first += times
    table = np.array(sorted(rows, key=lambda r: (r[0], r[2], r[3])), dtype=np.int64).reshape(-1, 4)
    before = np.cumsum(table[:, 1]) - table[:, 1]
    begins = np.r_[True, table[1:, 0] != table[:-1, 0]] if len(table) else np.zeros(0, bool)
    rank = before - np.maximum.accumulate(np.where(begins, before, 0)) if len(table) else before
    return {"length": table[:, 0], "rank": rank, "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, ids_crc32 (where asked for), sequence_id, offset.

    Each document is tokenised once, ended by END and cut into full windows and a rest. The pieces
    are written to the shared folder with their ids. The histogram of piece lengths (at most
    `window` bars) goes to the driver, which enumerates shallow combinations that fill a window,
    solves their repeat counts by non-negative least squares, rounds, and packs the residual
    pieces greedily. Workers look up a piece's place by its length and its rank among the pieces of
    that length: those of earlier tasks, a sum over one row per task and length, and those before
    it in its own. So no length meets in one task, and pieces aren't sorted or shuffled by length.
    The plan's size is bounded by the window too.

    digests adds ids_crc32, of the ids as four bytes each, the lowest first; ids=False leaves the
    ids out of the result.

    Sequences hold pieces gaplessly from offset 0; only the last ones of the greedy stage have
    padding at their end. Defined cases: null text counts as empty and gives the one id END; a very
    long text is cut like others, and its ids are those of `tokenizers`; rows with a null or
    repeated doc_id are packed like others, equal ones in the order in which they are read; an
    empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    pieces = stored(piece_table(source, path or tokenizer_path(), window), "pieces")
    counts = checkpoint(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    place = spark.sparkContext.broadcast(slots(plan_sequences(histogram, window)))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = place.value
        key = np.searchsorted(t["length"] * (1 << 48) + t["rank"], length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][key] + rank.to_numpy() - t["rank"][key], "offset": t["offset"][key]})

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    payload = ["ids"] * ids + ["ids_crc32"] * digests
    if digests:
        pieces = pieces.withColumn("ids_crc32", digest("ids"))
    ranked = pieces.select("doc_id", "start", "length", "doc_tokens", *payload, "task", "rank").join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    placed = ranked.withColumn("at", look_up("length", F.col("before") + F.col("rank")))
    return placed.select("doc_id", "start", "length", "doc_tokens", *payload, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


@F.arrow_udf(LongType())
def digest(ids: pa.Array) -> pa.Array:
    """CRC-32 of a list of ids, four bytes each, the lowest first."""
    raw = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
    ends = np.cumsum(ids.value_lengths().to_numpy()) * 4
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.int64())


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), ids=False, digests=True)


SQL = None
