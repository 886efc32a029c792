"""New transcripts as a stream: sentences come out as if all words of a video had come at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import thousandths
from ..operators.sentences import cut_sentences, ends_sentence
from ..schemas import SENTENCES, WORDS

#: Sentences as the stream tells them: n_words, and whether words may still be added.
TOLD = f"{SENTENCES}, n_words int, open boolean"
#: Groups that a stream's videos are dealt to; each has one state, and one call in Python a batch.
GROUPS = 1024
#: Words that a task packs by group at once.
PACKED = 500_000
#: Unless it is the largest there is, Spark sums up the bytes of a batch of Arrow before each row that it adds, which for words costs more than adding it.
#: 10,000 words stay far below any such limit.
BYTES_CHECK, UNCHECKED = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)
_TIMES = ["start", "end", "confidence"]
_PLACES = pa.schema([("video_id", pa.string()), ("pos", pa.int64()), ("sent_idx", pa.int64())])


def stream_words(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(WORDS)
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).parquet(path)


def stream_sentences(words: DataFrame, max_words: int = 50, pause: float = 1.0, groups: int = GROUPS) -> DataFrame:
    """words: a stream, whose pos numbers a video's words from 0. A stream of TOLD, for writing in append mode.

    The state of a video is where it stands: the pos and sent_idx with which its open sentence starts, the words
    of that one, max_words - 1 at most, and words that came too early, which wait for those before them. A word
    that comes again is left out, so batches may be repeated or overlap. Each batch tells the
    sentences that it closes, and the open one anew; no earlier word is read again. Videos are dealt by a hash to groups,
    whose words are cut together; a batch holds a group's words in memory, so more groups make smaller tasks. Their number stays as the first batch had it.
    What passes between Spark and these calls is tables of many words or sentences as Arrow's bytes, for a row of its own for each word costs several times the cutting.
    """

    def follow(key: tuple, frames, state: GroupState):
        came = [_table(b) for frame in frames for b in frame["words"]]
        held, places = (_table(b) for b in state.get) if state.exists else (came[0].slice(0, 0), _PLACES.empty_table())
        told, held, places = _follow(pa.concat_tables([held, *came]), held.num_rows, places, max_words, pause)
        state.update((_bytes(held), _bytes(places)))
        if told.num_rows:
            yield pd.DataFrame({"told": [_bytes(told)]})

    part = F.pmod(F.xxhash64("video_id"), F.lit(groups)).cast("int").alias("part")
    dealt = words.filter("pos >= 0").select(part, "video_id", "pos", "text", *_TIMES, ends_sentence("text").alias("mark")).mapInArrow(_pack, "part int, words binary")
    told = dealt.groupBy("part").applyInPandasWithState(follow, "told binary", "words binary, places binary", "append", GroupStateTimeout.NoTimeout)
    return told.mapInArrow(_unpack, TOLD).withColumns({c: thousandths(c) for c in _TIMES})


def _pack(batches):
    """Of each PACKED words or so, the words of each group as one row."""
    batches = iter(batches)
    while True:
        some, n = [], 0
        while n < PACKED and (batch := next(batches, None)) is not None:
            some.append(batch)
            n += batch.num_rows
        if not some:
            return
        table = pa.Table.from_batches(some)
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        table = table.drop_columns(["part"]).take(pa.array(order)).combine_chunks()
        first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)[:n])
        for k in range(0, len(first), 64):
            mine = [(a, b) for a, b in zip(first, np.append(first[1:], n))][k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array([part[order[a]] for a, _ in mine], pa.int32()), pa.array([_bytes(table.slice(a, b - a)) for a, b in mine], pa.binary())], names=["part", "words"])


def _unpack(batches):
    for batch in batches:
        for data in batch.column(0):
            yield from _table(data.as_py()).to_batches(max_chunksize=10_000)


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _follow(every: pa.Table, n_held: int, places: pa.Table, max_words: int, pause: float) -> tuple[pa.Table, pa.Table, pa.Table]:
    """What is told, and the next held words and places. every: n_held words of the state, then those that came."""
    known = places.num_rows
    encoded = pa.concat_arrays([*places.column("video_id").chunks, *every.column("video_id").chunks]).dictionary_encode("encode")
    video, names = encoded.indices.to_numpy()[known:], encoded.dictionary
    pos = every.column("pos").to_numpy()
    begin, number = (np.append(places.column(c).to_numpy(), np.zeros(len(names) - known, np.int64)) for c in ("pos", "sent_idx"))
    came = np.zeros(len(names), bool)
    came[video[n_held:]] = True

    # words of videos in the batch, in order and without those told before; held ones come first, so they stay
    asked = np.flatnonzero(came[video] & (pos >= begin[video]))
    asked = asked[np.lexsort((pos[asked], video[asked]))]
    v, p = video[asked], pos[asked]
    fresh = np.append(True, (v[1:] != v[:-1]) | (p[1:] != p[:-1]))[: len(v)]
    asked, v, p = asked[fresh], v[fresh], p[fresh]
    place, starts = np.arange(len(v)), np.append(True, v[1:] != v[:-1])[: len(v)]
    ready = p - begin[v] == place - np.maximum.accumulate(np.where(starts, place, 0))
    waiting, asked, v, p = asked[~ready], asked[ready], v[ready], p[ready]
    if not len(v):
        told, open_words = _told([], names, {}), asked
    else:
        rows = every.drop_columns(["video_id", "pos"]).take(pa.array(asked)).add_column(0, "video_id", pa.array(v)).combine_chunks().to_batches()[0]
        cut, first = cut_sentences(rows, 0, max_words, pause)
        after = np.append(first[1:], len(v))
        of, n_words, last = v[first], after - first, np.append(v[first][1:] != v[first][:-1], True)
        still = last & ~rows.column("mark").to_numpy(zero_copy_only=False)[after - 1] & (n_words < max_words)
        idx = cut.column("sent_idx").to_numpy() + number[of]
        told = _told(of, names, {"sent_idx": idx} | {c: cut.column(c) for c in ("text", *_TIMES)} | {"n_words": n_words.astype(np.int32), "open": still})
        begin[of[last]] = np.where(still, p[first], p[after - 1] + 1)[last]
        number[of[last]] = np.where(still, idx, idx + 1)[last]
        open_words = asked[np.repeat(still, n_words)]
    others = np.flatnonzero(~came[video[:n_held]])
    held = every.take(pa.array(np.concatenate([others, open_words, waiting]))).combine_chunks()
    return told, held, pa.table([names, begin, number], schema=_PLACES)


def _told(videos, names: pa.Array, columns: dict) -> pa.Table:
    return pa.table({"video_id": names.take(pa.array(videos, pa.int32()))} | columns)


def ingest(words: DataFrame, table: str, checkpoint: str, max_words: int = 50, pause: float = 1.0) -> StreamingQuery:
    """Writes the sentences of what arrives under `table`; read_sentences() reads them. Each batch has a folder of its own, so a repeated one overwrites itself, and nothing else is written again."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/sentences/batch={number}")

    told = stream_sentences(words, max_words, pause).writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    conf = words.sparkSession.conf
    before = conf.get(BYTES_CHECK)
    conf.set(BYTES_CHECK, UNCHECKED)
    try:
        return told.start()  # with a session of its own, which keeps the setting
    finally:
        conf.set(BYTES_CHECK, before)


def read_sentences(spark: SparkSession, table: str) -> DataFrame:
    """Every sentence as it was told last: the closed one, or the open one with most words.

    A sentence is closed in one batch only, so closed ones are read as they are. Of each video's open ones the last stays, if it wasn't closed.
    """
    every = spark.read.schema(TOLD).parquet(f"{table}/sentences")
    columns = ["sent_idx", "text", *_TIMES]
    closed = every.filter("NOT open")
    last = every.filter("open").groupBy("video_id").agg(F.max_by(F.struct(*columns), F.struct("sent_idx", "n_words")).alias("s")).select("video_id", "s.*")
    done = closed.groupBy(F.col("video_id").alias("of")).agg(F.max("sent_idx").alias("done"))
    still = last.join(done, F.col("video_id").eqNullSafe(F.col("of")), "left").filter("done IS NULL OR sent_idx > done")
    return closed.select("video_id", *columns).unionByName(still.select("video_id", *columns))
