"""An exact index for nearest neighbours: vectors in cells about pivots, of which a search reads those that can hold a hit.

The angle between two vectors obeys the triangle inequality. So a cell of radius r, that is the largest angle
between its pivot and a member, holds nothing nearer to a query than angle(query, pivot) - r. Once k hits are
known, cells that can't hold a better one are left out, and with them their files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vector import FLOOR, norm
from ..sources.tables import exists, replace_partitions
from .search import vector_search

#: Rows that a cell has on average, cells at most, and rows for each cell of the sample that pivots are chosen from.
CELL_ROWS, MOST_CELLS, SAMPLE = 4096, 1024, 32
#: The cell of vectors that have no direction: null ones, and those shorter than FLOOR. It is always read.
LOOSE = -1
#: Angles are widened by so much, for rounding.
SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(1)), FLOOR)[:, None]


def choose_pivots(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Pivots of unit length: rows of the sample far from each other, moved to the mean direction of the rows nearest to each, a few times."""
    rows = unit(sample)
    picked, near = [0], rows @ rows[0]
    while len(picked) < min(cells, len(rows)):
        k = int(near.argmin())
        picked.append(k)
        near = np.maximum(near, rows @ rows[k])
    pivots = rows[picked]
    for _ in range(rounds):
        at = (rows @ pivots.T).argmax(1)
        for c in np.unique(at):
            mean = rows[at == c].mean(0)
            if np.sqrt(mean @ mean) > FLOOR:
                pivots[c] = mean / np.sqrt(mean @ mean)
    return pivots


def sample_pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Pivots of the directed vectors with the smallest hashes, SAMPLE for each cell at most, which is all that the driver sees of them."""
    directed = vectors.filter(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > FLOOR)).select("embedding")
    rows = directed.orderBy(F.xxhash64("embedding"), "embedding").limit(cells * SAMPLE).collect()
    return choose_pivots(np.array([r[0] for r in rows], np.float64), cells) if rows else np.zeros((0, 0))


def celled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, that of the nearest pivot, and angle, to the pivot. The pivots go to the tasks; there are MOST_CELLS at most."""
    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])

    def place(batches):
        for batch in batches:
            column = batch.column("embedding")
            cell, angle = np.full(batch.num_rows, LOOSE, np.int32), np.zeros(batch.num_rows)
            given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(given) and len(pivots):
                rows = np.array(column.take(pa.array(given)).to_pylist(), np.float64)
                directed = np.sqrt((rows * rows).sum(1)) > FLOOR
                near = unit(rows[directed]) @ pivots.T
                cell[given[directed]], angle[given[directed]] = near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return vectors.mapInArrow(place, schema)


@dataclass(frozen=True)
class VectorIndex:
    """Rows under path/rows, a folder for each cell; pivots, radii and counts under path/cells."""

    spark: SparkSession
    path: str
    id_col: str = "id"

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("angle")

    @property
    def cells(self) -> DataFrame:
        """(cell, pivot, radius, n), MOST_CELLS rows and one."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def _describe(self, pivots: np.ndarray) -> None:
        rows = self.spark.read.parquet(f"{self.path}/rows").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
        told = {r["cell"]: r for r in rows}
        table = [(c, p.tolist(), told[c]["radius"] if c in told else 0.0, told[c]["n"] if c in told else 0) for c, p in enumerate(pivots)]
        table.append((LOOSE, None, math.pi, told[LOOSE]["n"] if LOOSE in told else 0))
        self.spark.createDataFrame(table, "cell int, pivot array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def bounds(self, query: list[float]) -> list[tuple[float, int, int]]:
        """(greatest score that a row can have, cell, rows) of all cells with rows, the most promising first."""
        q = unit(np.array([query], np.float64))[0]
        out = []
        for r in self.cells.filter("n > 0").collect():
            if r["cell"] == LOOSE or not q.any():
                out.append((1.0, r["cell"], r["n"]))
                continue
            apart = math.acos(max(-1.0, min(1.0, float(q @ np.array(r["pivot"])))))
            out.append((max(0.0, math.cos(max(0.0, apart - r["radius"] - SLACK))), r["cell"], r["n"]))
        return sorted(out, key=lambda b: (-b[0], b[1]))

    def needed(self, query: list[float], where=None, k: int = 10) -> list[int]:
        """Cells that can hold one of the k nearest rows: read from the most promising on, ever more of them, until the k-th score found is above what the next can hold."""
        cells, take = self.bounds(query), 0
        while take < len(cells):
            rows, before = 0, take
            while take < len(cells) and (rows < k or take < 2 * before or cells[take][0] == 1.0):
                rows += cells[take][2]
                take += 1
            if take == len(cells):
                break
            hits = vector_search(self._of([c for _, c, _ in cells[:take]], where), query, None, k, self.id_col).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            if hits["n"] == k:
                return [c for bound, c, _ in cells if bound >= hits["least"] - SLACK]
        return [c for _, c, _ in cells]

    def _of(self, cells: list[int], where) -> DataFrame:
        rows = self.rows.filter(F.col("cell").isin(cells))
        return rows if where is None else rows.filter(where)

    def search(self, query: list[float], where=None, k: int = 10) -> DataFrame:
        """The rows that vector_search() gives over all rows, from the files of the cells needed."""
        return vector_search(self._of(self.needed(query, where, k), where).drop("cell"), query, None, k, self.id_col)

    def upsert(self, vectors: DataFrame) -> None:
        """Puts rows in, in place of those with the same ids; of repeated ids the one with the largest vector stays. Only the cells that lose or gain rows are written again; the pivots stay."""
        pivots = np.array([r["pivot"] for r in self.cells.filter(F.col("cell") != LOOSE).orderBy("cell").collect()])
        kept = self.spark.read.parquet(f"{self.path}/rows")
        new = celled(vectors.select(*[c for c in kept.columns if c not in ("cell", "angle")]), pivots)
        new = new.groupBy(self.id_col).agg(F.max_by(F.struct(*new.columns), F.struct(F.col("embedding").isNotNull(), "embedding")).alias("r")).select("r.*")
        touched = kept.join(new.select(self.id_col), self.id_col, "left_semi").select("cell").union(new.select("cell")).distinct()
        cells = [r["cell"] for r in touched.collect()]  # MOST_CELLS and one at most
        left = kept.filter(F.col("cell").isin(cells)).join(new.select(self.id_col), self.id_col, "left_anti")
        replace_partitions(left.unionByName(new.select(*kept.columns)), f"{self.path}/rows", "cell", cells)
        self._describe(pivots)


def build_index(vectors: DataFrame, path: str, id_col: str = "id", cells: int = 0) -> VectorIndex:
    """Writes an index of all rows and opens it. Pivots come from a bounded sample, the rows are dealt by cell, and Spark splits cells of many rows into several files."""
    spark = vectors.sparkSession
    wanted = cells or min(MOST_CELLS, max(1, -(-vectors.count() // CELL_ROWS)))
    pivots = sample_pivots(vectors, wanted)
    celled(vectors, pivots).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, id_col)
    index._describe(pivots)
    return index


def open_or_build(vectors: DataFrame, path: str, **how) -> VectorIndex:
    """The index at path, or a new one of the vectors where there is none."""
    if exists(vectors.sparkSession, f"{path}/cells"):
        return VectorIndex(vectors.sparkSession, path, **{k: v for k, v in how.items() if k != "cells"})
    return build_index(vectors, path, **how)
