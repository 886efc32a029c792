"""State of loops, and numbering of rows, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import itertools
import math
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets a temporary one."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at:
        return at
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "quillmap-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so lost executors don't lose what was computed. Spark's cleaner removes it if it is on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value):
    """A setting of the session for what is run in the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a task where rows are dealt by number: a few hundred bytes each, they sort in memory.
ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, whose rows are counted, by a hash of keys in partitions of ROWS or so; as it is if one would do.

    Otherwise AQE joins partitions by their bytes in the shuffle, and a task's rows, once joined with wide ones, outgrow its memory.
    Spark deals anew what has fewer partitions than spark.sql.shuffle.partitions, so there are that many at least.
    """
    if rows <= ROWS:
        return df
    return df.repartition(max(math.ceil(rows / ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


class Steps:
    """States of a loop, each written as Parquet in the shared folder and read again; all are removed at the end of the block.

    A checkpoint keeps the planner's estimate of what made it, and estimates of joins multiply, so in
    a loop they grow without bound; files have their real size. What outlives the block is cut().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.at)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):  # what was shuffled for it goes once it is written, and not when the driver's memory is cleared
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


    def keep_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Also the number of rows, which the write itself counts."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return kept, seen.get["n"]


def runs(batches):
    """The rows, as tuples, of each run of one value in the first column, of Arrow batches of sorted rows; a run may span batches."""
    rows = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def values(column: pa.Array) -> list:
    """As to_pylist(), which makes an object of Arrow's for each value first, of strings, lists of strings and numbers."""
    if pa.types.is_list(column.type):
        flat, ends = values(column.values), column.offsets.to_numpy().tolist()
        lists = [flat[a:b] for a, b in itertools.pairwise(ends)]
        return [x if given else None for x, given in zip(lists, column.is_valid().to_numpy(False).tolist())] if column.null_count else lists
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def told(rows, schema: pa.Schema, size: int = 10_000):
    """Arrow batches of `size` tuples."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds n, the place of each row in an order over all rows, from 0. Ranges are numbered by themselves, after the rows of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(sizes.select("_range", before.alias("_before")), "_range").withColumn("n", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
