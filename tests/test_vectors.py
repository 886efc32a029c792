import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import resolve, vector_index
from quillmap.operators.search import vector_search

VECTORS = "id long, kind int, embedding array<double>"


def clustered(rng, n=900, groups=12, dims=16, spread=0.08):
    """Vectors about a few directions, some repeated, opposite, tiny, zero or null."""
    centres = rng.normal(size=(groups, dims))
    made = [(k, int(g), (centres[g] * rng.uniform(0.1, 5) + rng.normal(size=dims) * spread).tolist()) for k, g in enumerate(rng.integers(0, groups, n))]
    made += [(n + k, 0, made[k][2]) for k in range(5)] + [(n + 10 + k, 1, [-x for x in made[k][2]]) for k in range(3)]
    return made + [(n + 20, 2, [0.0] * dims), (n + 21, 2, None), (n + 22, 3, [1e-12] * dims), (n + 23, 3, [1e-9] * dims)]


def told(df):
    return [(r.id, None if r.score is None else round(r.score, 9)) for r in df.collect()]


def files_of(rows):
    return rows.select(F.input_file_name()).distinct().count()


@pytest.fixture(scope="module")
def made():
    return clustered(np.random.default_rng(5))


@pytest.mark.parametrize("cells", [1, 20])
def test_the_index_gives_what_a_full_scan_gives(spark, tmp_path, made, cells):
    df = spark.createDataFrame(made, VECTORS).repartition(3)
    index = vector_index.build_index(df, str(tmp_path / "x"), cells=cells)
    assert index.cells.agg(F.sum("n")).first()[0] == len(made) and index.cells.count() <= cells + 1
    rng = np.random.default_rng(1)
    queries = [made[0][2], rng.normal(size=16).tolist(), [0.0] * 16]
    for q in queries:
        for where, k in ((None, 10), (F.col("kind") == 3, 10), (F.col("kind") == 99, 4), (None, 2000)):
            assert told(index.search(q, where, k)) == told(vector_search(df, q, where, k))


def test_a_search_reads_the_cells_that_can_hold_a_hit(spark, tmp_path, made):
    df = spark.createDataFrame(made, VECTORS)
    index = vector_index.build_index(df, str(tmp_path / "x"), cells=24)
    for k in (0, 9, 33):
        read = index._of(index.needed(made[k][2], None, 10), None)
        assert files_of(read) < 0.5 * files_of(index.rows) and read.count() < 0.5 * len(made)
        assert "PartitionFilters: [cell" in index.search(made[k][2])._jdf.queryExecution().toString()


def test_rows_are_put_in(spark, tmp_path, made):
    path = str(tmp_path / "x")
    index = vector_index.open_or_build(spark.createDataFrame(made, VECTORS), path, cells=12)
    before = {r.cell: r.n for r in index.cells.collect()}
    new = [(5, 7, made[40][2]), (6, 7, None), (5000, 8, made[41][2]), (5001, 8, [3.0] * 16), (5001, 9, [2.0] * 16)]
    index.upsert(spark.createDataFrame(new, VECTORS))
    want = spark.createDataFrame([r for r in made if r[0] not in (5, 6)] + new[:4], VECTORS)
    again = vector_index.open_or_build(spark.createDataFrame([], VECTORS), path)
    assert again.rows.count() == want.count() == sum(r.n for r in again.cells.collect()) and {r.cell for r in again.cells.collect()} == set(before)
    for q in (made[40][2], [1.0] * 16, made[5][2]):
        assert told(again.search(q, None, 30)) == told(vector_search(want, q, None, 30))
    index.upsert(spark.createDataFrame([], VECTORS))
    assert again.rows.count() == want.count()


def test_an_index_of_nothing(spark, tmp_path):
    index = vector_index.build_index(spark.createDataFrame([(1, 1, None)], VECTORS), str(tmp_path / "x"))
    assert told(index.search([1.0, 2.0])) == [(1, 0.0)]  # no vector counts as no likeness


def plain_pairs(made, threshold):
    rows = [(k, np.array(v)) for k, _, v in made if v is not None]
    u = [(k, v / max(np.sqrt(v @ v), 1e-10)) for k, v in rows]
    return {(min(a, b), max(a, b)): round(float(x @ y), 6) for n, (a, x) in enumerate(u) for b, y in u[:n] if x @ y >= threshold}


@pytest.mark.parametrize("threshold, rows, cells", [(0.75, 2048, 0), (0.97, 30, 9), (0.75, 25, 30), (-0.5, 100, 3)])
def test_pruned_pairs_are_all_pairs(spark, monkeypatch, threshold, rows, cells):
    made = clustered(np.random.default_rng(8), n=300)
    monkeypatch.setattr(resolve, "BLOCK_ROWS", rows)
    df = spark.createDataFrame([(k, v) for k, _, v in made], "idx long, embedding array<double>").repartition(3)
    got = resolve.similar_pairs(df, threshold, cells).collect()
    assert len(got) == len({(r.idx_a, r.idx_b) for r in got})
    assert {(r.idx_a, r.idx_b): round(r.sim, 6) for r in got} == plain_pairs(made, threshold)


def test_most_pairs_of_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 40)
    df = spark.createDataFrame([(k, v) for k, _, v in clustered(np.random.default_rng(5), spread=0.01)[:900]], "idx long, embedding array<double>")
    rows, blocks, pivots = resolve.in_blocks(df, 12)
    n = blocks.count()
    met = resolve.block_partners(blocks, pivots, 0.75).agg(F.sum(F.size("partners"))).first()[0]
    assert n > 20 and met < 0.35 * n * (n + 1) / 2, (n, met)
