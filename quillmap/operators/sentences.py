"""Words with times to sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import thousandths
from ..schemas import SENTENCES

#: Marks that end a sentence. Fixed values.
ENDINGS = [".", "?", "!", "。", "？", "！"]


def scan_words(words: DataFrame) -> DataFrame:
    """Trims texts and rounds times and confidences to three places."""
    return words.withColumns({"text": F.trim("text")} | {c: thousandths(c) for c in ("start", "end", "confidence")})


def ends_sentence(text: str) -> Column:
    return F.coalesce(F.substring(text, -1, 1).isin(ENDINGS), F.lit(False))


def group_sentences(words: DataFrame, max_words: int = 50, pause: float = 1.0) -> DataFrame:
    """words: (video_id, pos, text, start, end, confidence). A sentence ends with a mark of ENDINGS, before a pause, or after max_words.

    Breaks are known from a word and the next one, and within a run between them every max_words words make a sentence. Words are
    sorted by video and place once, after one shuffle by video, and cut batch by batch; of a batch only the words
    of its last sentence wait for the next one, so no group is made for a video.
    """

    def fold(batches):
        rows, at = None, 0
        for batch in batches:
            if batch.num_rows:
                rows = batch if rows is None else pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(rows.columns, batch.columns)], schema=batch.schema)
                told, first = cut_sentences(rows, at, max_words, pause)
                yield told.slice(0, told.num_rows - 1)
                rows, at = rows.slice(int(first[-1])), told.column("sent_idx")[-1].as_py()
        if rows is not None:
            yield cut_sentences(rows, at, max_words, pause)[0]

    ordered = words.select(F.col("video_id").cast("string"), "pos", "text", *[F.col(c).cast("double") for c in ("start", "end", "confidence")], ends_sentence("text").alias("mark")).repartition("video_id").sortWithinPartitions("video_id", "pos")
    return ordered.drop("pos").mapInArrow(fold, SENTENCES).withColumns({c: thousandths(c) for c in ("start", "end", "confidence")})


def cut_sentences(rows: pa.RecordBatch, at: int, max_words: int, pause: float) -> tuple[pa.RecordBatch, np.ndarray]:
    """The sentences of sorted words, and the rows in which they start. at: the number of the first one in its video."""
    n, video, (start, end) = rows.num_rows, rows.column("video_id").dictionary_encode("encode").indices.to_numpy(), (rows.column(c) for c in ("start", "end"))
    gap = pc.subtract(start.slice(1), end.slice(0, n - 1))
    wide = pc.or_(pc.greater(gap, pause), pc.is_nan(gap)).fill_null(False).to_numpy(zero_copy_only=False)
    new = np.append(True, video[1:] != video[:-1])
    fresh = new.copy()
    fresh[1:] |= rows.column("mark").to_numpy(zero_copy_only=False)[:-1] | wide
    every = np.arange(n)
    starts = (every - np.maximum.accumulate(np.where(fresh, every, 0))) % max_words == 0
    first = np.flatnonzero(starts)
    after, number, of = np.append(first[1:], n), np.arange(len(first)), np.cumsum(starts) - 1
    opens = np.maximum.accumulate(np.where(new[first], number, 0))
    there = rows.column("text").is_valid().to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(there)[after - 1]).astype(np.int32), rows.column("text").drop_null())
    sure = rows.column("confidence").is_valid().to_numpy(zero_copy_only=False)
    known = np.bincount(of[sure], minlength=len(first))
    total = np.bincount(of[sure], rows.column("confidence").drop_null().to_numpy(), len(first))
    mean = pa.array(total / np.maximum(known, 1), mask=known == 0)
    columns = [rows.column("video_id").take(pa.array(first)), pa.array(number - opens + np.where(opens == 0, at, 0)), pc.binary_join(lists, " "), start.take(pa.array(first)), end.take(pa.array(after - 1)), mean]
    return pa.RecordBatch.from_arrays(columns, names=["video_id", "sent_idx", "text", "start", "end", "confidence"]), first


def durations(sentences: DataFrame) -> DataFrame:
    """(video_id, duration): where each video's last sentence ends."""
    return sentences.groupBy("video_id").agg(F.max_by("end", "sent_idx").alias("duration"))
