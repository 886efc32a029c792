"""Maximal periodic runs of words, by prefix hashes on a harmonic grid."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_slices, read_documents

#: A run has at least so many words and so many periods.
RUN_WORDS, RUN_PERIODS = 6, 4
#: Pairs of words that are looked at together, so that memory doesn't grow with a text.
AT_ONCE = 1 << 20
#: Modulus of the prefix hashes; two of them with bases of their own count as one.
MERSENNE = (1 << 31) - 1


def ranges(first: np.ndarray, count: np.ndarray, step: np.ndarray | int = 1) -> np.ndarray:
    """first[k], first[k] + step[k], ... count[k] of them, for one k after the other."""
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + inside * (step if np.isscalar(step) else np.repeat(step, count))


def portions(count: np.ndarray) -> Iterator[slice]:
    """Slices of neighbours whose counts together are at most AT_ONCE; a larger one stands alone."""
    ends, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        yield slice(a, b)
        a = b


class PrefixHashes:
    """Polynomial hashes of all stretches of some numbers, each from two prefix sums."""

    def __init__(self, ids: np.ndarray, attempt: int):
        self.sums, self.powers = [], []
        for base in np.random.default_rng([11, attempt]).integers(1 << 20, MERSENNE, 2).tolist():
            power = np.ones(1, np.int64)
            while len(power) <= len(ids):
                power = np.r_[power, power * pow(base, len(power), MERSENNE) % MERSENNE]
            self.powers.append(power)
            self.sums.append(np.r_[0, np.cumsum((ids + 1) * power[: len(ids)] % MERSENNE)])

    def alike(self, i: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of that length from i and from i + shift have one hash."""
        out = np.ones(len(i), bool)
        for s, power in zip(self.sums, self.powers):
            out &= ((s[i + length] - s[i]) % MERSENNE * power[shift] - (s[i + shift + length] - s[i + shift])) % MERSENNE == 0
        return out

    def extent(self, i: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from i on (or, back, before i) agree with those shift later, `most` at most: one binary search for all."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left] + 1) // 2
            at = i[left] - middle if back else i[left]
            same = self.alike(at, shift[left], middle)
            low[left] = np.where(same, middle, low[left])
            high[left] = np.where(same, high[left], middle - 1)
            left = left[low[left] < high[left]]
        return low


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Columns start, end, period: of those with one start and end the least period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    return runs[:, np.r_[True, (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)]] if runs.shape[1] else runs


def find_runs(ids: np.ndarray, offsets: np.ndarray, attempt: int = 0) -> np.ndarray:
    """Rows start, end, period of all runs, by start and end. ids are the words of several texts as numbers below 2^31 - 1, text k from offsets[k] to offsets[k + 1].

    A run of period p has RUN_PERIODS * p words at least, so one of the points 0, (RUN_PERIODS - 1) * p,
    ... of its text lies in it together with the word p later. For every p and every such point that
    has the same word p later, both extents are found, of all texts and periods at once; the points of
    a text of n words are about n * log(n) / (RUN_PERIODS - 1). The stretch found is maximal for p, and
    if p isn't its least period, then that one divides p and finds the same stretch, so the least
    period of each stretch is kept. Words are compared in the end; should a hash have deceived, all is
    done again with other bases.
    """
    sizes = np.diff(offsets)
    periods_of = np.where(sizes >= RUN_WORDS, sizes // RUN_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods_of)
    period = ranges(np.ones(len(sizes), np.int64), periods_of)
    points = (sizes[text] - period - 1) // ((RUN_PERIODS - 1) * period) + 1
    hashes, found = PrefixHashes(ids, attempt), [np.zeros((3, 0), np.int64)]
    for part in portions(points):
        t, p = (np.repeat(x[part], points[part]) for x in (text, period))
        i = ranges(offsets[text[part]], points[part], (RUN_PERIODS - 1) * period[part])
        same = np.flatnonzero(ids[i] == ids[i + p])
        i, p, t = i[same], p[same], t[same]
        end = i + p + hashes.extent(i, p, offsets[t + 1] - i - p, False)
        start = i - hashes.extent(i, p, i - offsets[t], True)
        long = end - start >= np.maximum(RUN_WORDS, RUN_PERIODS * p)
        found.append(least_periods(np.stack([start[long], end[long], p[long]])))
    runs = least_periods(np.concatenate(found, 1))
    for part in portions(runs[1] - runs[0]):
        start, end, p = runs[:, part]
        at = ranges(start, end - start - p)
        if (ids[at] != ids[at + np.repeat(p, end - start - p)]).any():
            return find_runs(ids, offsets, attempt + 1)
    return runs


#: The columns after doc_id.
FOUND = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def describe(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns FOUND of one text, from its words and its runs (start, end, period)."""
    start, end, period = runs
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = (None, None, None, None)
    if len(start):
        k = np.lexsort((period, start, start - end))[0]
        length = int(end[k] - start[k])
        best = (int(start[k]), length, int(period[k]), 1000 * length // int(period[k]))
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, start + period, 1)
        np.add.at(marks, end, -1)
        words = itertools.compress(words, (np.cumsum(marks[:-1]) == 0).tolist())
    order = np.lexsort((period, start))
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in zip(start[order].tolist(), end[order].tolist(), period[order].tolist()))
    return (len(start), *best, sha(listed.encode()), sha(b" ".join(words)))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weave: Callable[[str, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of words with least period q
    (words q apart are the same) and max(6, 4 * q) words or more, which no neighbour extends. The longest run
    is told (of equal ones the first, then that of the least period), runs_sha256 is the digest of all runs as
    `start,length,period` and a line feed, and collapsed_sha256 that of the text without what a run repeats: the
    words that stay, with a space between, are all but those in a run after its first q words.

    weave, if given, gets a row's id as text and its number of words n and may give (a, p): then
    each word i >= a counts as word a + (i - a) % p before runs are looked for.

    Each row is read by itself, so nothing is shuffled, and one task's work follows its texts. Some
    hundred texts are searched at once; memory follows the longest of these.

    Defined cases: null, empty and white texts have no words, no runs and four nulls; the digest of no
    runs is that of the empty text; very long texts are read whole, all their periods included; rows
    without doc_id are searched like others (weave isn't asked about them); repeated rows give repeated
    rows; an empty table gives no rows; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType

    @in_slices(rows=256)
    def search(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "replace").split() for t in batch.column("text").to_pylist()]
            if weave is not None:
                for k, key in enumerate(batch.column("key").to_pylist()):
                    own = weave(key, len(texts[k])) if key is not None and texts[k] else None
                    if own:
                        a, p = own
                        texts[k] = texts[k][:a] + [texts[k][a + j % p] for j in range(len(texts[k]) - a)]
            numbers: dict[bytes, int] = {}
            every = list(itertools.chain.from_iterable(texts))
            ids = np.fromiter(map(numbers.setdefault, every, itertools.count()), np.int64, len(every))
            offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
            runs = find_runs(ids, offsets)
            cuts = np.searchsorted(runs[0], offsets)
            rows = [describe(t, runs[:, a:b] - np.array([[o], [o], [0]])) for t, a, b, o in zip(texts, cuts, cuts[1:], offsets)]
            columns = [pa.array(c, pa.string() if FOUND[n] == "string" else pa.int64()) for n, c in zip(FOUND, zip(*rows))] if rows else [pa.array([], pa.string() if t == "string" else pa.int64()) for t in FOUND.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *FOUND])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), as_text(F.col(text_col)).alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in FOUND.items()))


def woven(key: str, n: int) -> tuple[int, int] | None:
    """The repetition that the contract weaves into one text of ten."""
    h = zlib.crc32(key.encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def query(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(read_documents(spark, sf_dir), weave=woven)


#: DuckDB has no crc32, and all runs of whole texts are too slow in SQL; the tests hold the result against brute force.
SQL = None
