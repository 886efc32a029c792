"""Lloyd's algorithm in whole numbers over distinct vectors with their multiplicities."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import in_slices, stored

#: Clusters, rounds, components of a vector, units that 1.0 has, and the salt of the hash that picks the first centroids.
CLUSTERS, ROUNDS, DIMS, UNITS, SALT = 8, 10, 64, 1024, "3"
#: Largest component with which doubles, and 64-bit integers, hold every sum of squares exactly.
IN_DOUBLE, IN_LONG = 1 << 22, 1 << 27
MOST_LONG = (1 << 63) - 1


def quantised(vector: Column, dims: int, units: int) -> Column:
    """Whole components, or null for a vector that isn't kept."""
    whole = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * units)))


def key_of(vector: Column) -> Column:
    """Digest of the components as text: equal vectors only have equal ones."""
    return F.sha2(F.array_join(vector.cast("array<string>"), ",").cast("binary"), 256)


def largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0))))


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid, the smaller one of equal ones, and the squared distance to it, exactly."""
    most = max(largest(vectors), *(abs(v) for row in centroids for v in row))
    kind = np.float64 if most <= IN_DOUBLE else np.int64 if most <= IN_LONG else object
    x, c = vectors.astype(kind), np.array(centroids, dtype=object).astype(kind)
    far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    at = far.argmin(1)
    return at, [int(d) for d in far[np.arange(len(x)), at]]


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def moved(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid at the rounded-down mean of its vectors; those without vectors stay. Tasks send one row of sums for each cluster."""

    @in_slices(rows=8192)
    def sums(batches):
        total, weight = {}, {}
        for batch in batches:
            x, n = as_matrix(batch.column("vector"), dims), batch.column("n").to_numpy()
            at, _ = nearest(x, centroids)
            for c in np.unique(at).tolist():
                own = at == c
                narrow = largest(x) * int(n[own].sum()) <= MOST_LONG
                part = (n[own] @ x[own]) if narrow else n[own].astype(object) @ x[own].astype(object)
                total[c] = [int(a) + b for a, b in zip(part, total.get(c, [0] * dims))]
                weight[c] = weight.get(c, 0) + int(n[own].sum())
        rows = sorted(total)
        whole = pa.decimal128(38, 0)
        lists = pa.array([[Decimal(v) for v in total[c]] for c in rows], pa.list_(whole))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([weight[c] for c in rows], pa.int64()), lists], names=["cluster", "n", "sums"])

    parts = distinct.select("vector", "n").mapInArrow(sums, "cluster int, n long, sums array<decimal(38,0)>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims)])
    out = list(centroids)
    for row in whole.collect():  # a row for each cluster
        out[row["cluster"]] = [int(row[f"s{k}"]) // row["n"] for k in range(dims)]
    return out


def assigned(distinct: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(key, n, cluster, distance); a distance beyond 64 bits is null."""

    @in_slices(rows=8192)
    def assign(batches):
        for batch in batches:
            at, far = nearest(as_matrix(batch.column("vector"), dims), centroids)
            distance = pa.array([d if d <= MOST_LONG else None for d in far], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(at.astype(np.int32)), distance], names=["key", "n", "cluster", "distance"])

    return distinct.select("key", "n", "vector").mapInArrow(assign, "key string, n long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, units: int = UNITS, salt: str = SALT) -> DataFrame:
    """One row per kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dims` components, none null or non-finite, each of which becomes the whole
    number floor(units * x). Equal ones are grouped with their multiplicity, and rounds go over the distinct
    ones only, weighted: each task assigns its vectors and sends sums for each cluster, which Spark
    adds up, so a round moves a row for each cluster and task. All is exact, since it is in whole numbers, and so
    doesn't depend on order. Rounds end early when no centroid moves, as all later ones would do the
    same. The assignments are written and come back to the rows by a join on the vectors' digests,
    whose large side AQE can split where one vector has very many rows. The centroids are the only
    state on the driver.

    Centroids start as the kept vectors with the smallest sha256 of `salt:id`, in that order, of one id
    those with the smaller components first; fewer rows than clusters give fewer centroids. Ties of distance
    go to the smaller number, and a centroid without vectors stays where it is.

    Defined cases: null vectors and those of other lengths give no row; a null id counts as an empty
    one in the hash and is assigned like others; repeated rows count as often as they stand and give
    repeated rows; components beyond 64 bits become the nearest number that 64 bits hold, a distance or
    an inertia beyond is null; an empty table, or one without kept rows, gives no rows; further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), dims, units).alias("vector")).filter("vector IS NOT NULL")
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = [list(r["vector"]) for r in rows.withColumn("drawn", drawn).orderBy("drawn", "vector").limit(clusters).collect()]
    if not first:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], none.cast("string").alias("centroid_sha256"))
    with Steps(vectors.sparkSession) as steps:
        distinct = steps.keep(rows.groupBy(key_of(F.col("vector")).alias("key")).agg(F.first("vector").alias("vector"), F.count("*").alias("n")))
        centroids = first
        for _ in range(rounds):
            before, centroids = centroids, moved(distinct, centroids, dims)
            if before == centroids:
                break
        marked = stored(assigned(distinct, centroids, dims), "assigned")
    weighed = F.col("distance").cast("decimal(38,0)") * F.col("n")
    told = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(weighed)).alias("inertia")
    inertia = {r["cluster"]: r["inertia"] for r in marked.groupBy("cluster").agg(told).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    fits = lambda v: F.lit(None if v is None or v > MOST_LONG else int(v)).cast("long")
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = rows.select("vec_id", key_of(F.col("vector")).alias("key")).join(marked.select("key", "cluster", "distance"), "key")
    return found.select("vec_id", "cluster", "distance", of_cluster([fits(inertia.get(k)) for k in range(len(centroids))]).alias("cluster_inertia"), fits(whole).alias("inertia"), of_cluster([F.lit(x) for x in digests]).alias("centroid_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after the other, as SQL; vectors are lists of whole numbers."""
    far = "list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(dims=DIMS)
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), v) - 1 AS k, v AS c FROM kept ORDER BY sha256('{SALT}:' || vec_id), v LIMIT {CLUSTERS})",
    ]
    near = f"SELECT vec_id, any_value(v) AS v, min({{{{'d': {far}, 'k': k}}}}) AS best FROM kept, {{c}} GROUP BY vec_id"
    for r in range(1, ROUNDS + 1):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r - 1}')})",
            f"s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY k, i)",
            f"c{r} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r - 1} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY k) USING (k))",
        ]
    steps.append(f"last AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} ON k = best.k"""


#: Tables with repeated vec_ids are beyond it.
SQL = _sql()
