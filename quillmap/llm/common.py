"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iteration import cut, remove, shared_folder

#: ASCII white space, as every word rule of this subpackage understands it.
WHITE = r"[\x20\x09-\x0D]"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names.

    The files go when the frame is no longer referenced, if the session has
    `spark.cleaner.referenceTracking.cleanCheckpoints` on.
    """
    return cut(df)


Folders = list[tuple[SparkSession, str]]

#: Folders of callers that own none of their own; they go when the process ends.
UNOWNED: Folders = []
#: Where stored() notes its folders; each thread has its own.
OWNER: ContextVar[Folders] = ContextVar("OWNER", default=UNOWNED)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: smaller than a checkpoint, columns are read as needed, and the planner knows the real size. For what a returned frame still reads; it stays until the block of owned() ends in which it was written, or else the process. What no returned frame reads is kept by Steps."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    OWNER.get().append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(folders: Folders) -> None:
    while folders:
        spark, path = folders.pop()
        if spark.sparkContext._jsc is not None:  # the session may have been stopped
            remove(spark, path)


atexit.register(discard, UNOWNED)


@contextlib.contextmanager
def owned():
    """What is stored within, in this thread, goes at the end of the block, when no frame that reads it may be used any more. Other threads and blocks keep theirs."""
    mine: Folders = []
    before = OWNER.set(mine)
    try:
        yield
    finally:
        OWNER.reset(before)
        discard(mine)


def in_slices(f=None, *, rows: int = 500):
    """Makes a function of Arrow batches see at most `rows` rows at a time, so what a worker holds stays small. Spark itself ends batches at 64 MB."""
    if f is None:
        return functools.partial(in_slices, rows=rows)

    @functools.wraps(f)
    def sliced(batches):
        return f(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))

    return sliced


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def squeeze(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; runs that are one space already aren't touched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`: the spaces left after squeezing and trimming, and one."""
    flat = F.trim(squeeze(text))
    return F.when(F.length(flat) == 0, F.lit(0)).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def crc32_of(text: Column) -> Column:
    return F.crc32(text.cast("binary")).cast("long")


def as_rows(docs: DataFrame) -> DataFrame:
    """docs with each whole row as the one column `row`, so that further columns can be added whatever names the row has."""
    return docs.select(F.struct("*").alias("row"))
