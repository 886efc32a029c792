"""Tables as Parquet in folders by the value of a column, of which some are written anew."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.iteration import remove, setting


#: Folders that the rows of a table are dealt over, by a hash of their owner.
PARTS = 64
#: Folders up to which rows read from files are written without a shuffle.
FEW = 16
#: Owners of a folder up to which they go beside its rows.
BESIDE = 500_000


def part_of(owner: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(parts)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def replace_partitions(rows: DataFrame, path: str, by: str, values: list | None = None, shuffle: bool = True) -> list:
    """Writes the rows' partitions anew and leaves all others; the values of `by` that were written.

    rows may read the table itself, as the files take their places when all are written. values, if given,
    names the partitions to replace; those without rows are removed then. Rows that are in few tasks, and go to few
    partitions, needn't be shuffled: each task writes a file in each partition.
    """
    spark, seen = rows.sparkSession, Observation()
    out = (rows.hint("rebalance", by) if shuffle else rows).observe(seen, F.collect_set(by).alias("values")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", 0 if shuffle else FEW):  # so many files are open at once in a task, or else its rows are sorted
        out.parquet(path)
    present = list(seen.get["values"])
    gone = [v for v in values or [] if v not in present]
    for v in gone:
        remove(spark, f"{path}/{by}={v}")
    return sorted([*present, *gone])


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows where none was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def folders_of(owners: DataFrame, owner: str, parts: int = PARTS) -> list[int]:
    """The numbers of the owners' folders, `parts` at most."""
    return sorted(r[0] for r in owners.select(part_of(owner, parts)).distinct().collect())


def without(rows: DataFrame, owner: str, owners: DataFrame, touched: list[int], parts: int, n: int | None) -> DataFrame:
    """Rows, with their part, of none of the owners. Where their number is known, those of a folder go beside its rows, BESIDE at most on average, and rows aren't shuffled."""
    if n == 0:
        return rows
    if n is None or n > BESIDE * len(touched):
        return rows.join(owners, owner, "left_anti")
    placed = owners.withColumn("part", part_of(owner, parts))
    each = [rows.filter(F.col("part") == k).join(F.broadcast(placed.filter(F.col("part") == k).select(owner)), owner, "left_anti") for k in touched]
    return functools.reduce(DataFrame.unionByName, each)


def replace_rows(rows: DataFrame, path: str, owner: str, owners: DataFrame, touched: list[int], parts: int = PARTS, n: int | None = None) -> list[int]:
    """Puts rows in, in place of all that the owners had. owners: (owner), touched: the folders_of() these and of the rows, n: how many owners there are, if that was counted.

    Rows lie in folders by a hash of their owner; only folders of those owners are written again, with what
    else is in them, and the numbers of these are returned. No owners write nothing.
    """
    if not touched:
        return []
    new = rows.withColumn("part", part_of(owner, parts))
    if exists(rows.sparkSession, path):
        old = rows.sparkSession.read.schema(new.schema).parquet(path).filter(F.col("part").isin(touched))
        new = without(old, owner, owners, touched, parts, n).select(new.columns).unionByName(new)
    return replace_partitions(new, path, "part", touched, parts > FEW)
