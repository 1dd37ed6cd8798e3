"""Odd inputs and larger tables: findings of the third round."""

import duckdb
import numpy as np
import pytest
import numpy as np
import pytest
from compare import check

import tessera.queries  # noqa: F401
from tessera.operators import graph, linalg, panels, sparse, stats
from tessera.registry import ORACLES, QUERIES

NAN = float("nan")


def test_divide_nulls_and_nans_over_zero(spark, tmp_path):
    prices = [None, NAN, 0.0, -0.0, 3.0, -3.0, float("inf")]
    rows = [(i, j, q, 0.0, 0.0, p) for i, p in enumerate(prices) for j, q in enumerate([25.0, 26.0, None, NAN])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert check(spark, con, str(tmp_path), QUERIES["divide"], ORACLES["divide"]) == ""


def _brute(x, labels, metric):
    gap = np.abs(x[:, None] - x[None])
    d = np.sqrt((gap**2).sum(axis=2)) if metric == "euclidean" else gap.sum(axis=2) if metric == "l1" else gap.max(axis=2)
    out = []
    for i, c in enumerate(labels):
        same = labels == c
        a = d[i, same].sum() / max(1, same.sum() - 1)
        b = min(d[i, labels == k].mean() for k in set(labels.tolist()) - {c})
        out.append(0.0 if same.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("metric", ["euclidean", "l1", "linf"])
def test_silhouettes_by_blocks(spark, metric):
    """More than one block, copies, a far cluster and one of a single point; each block moves once a pair."""
    rng = np.random.default_rng(31)
    x = rng.standard_normal((1300, 5)) + 1e3
    labels = np.sort(rng.integers(0, 4, len(x)))
    x[100:160], labels[-1] = x[100], 77
    points = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), labels))], "row long, vec array<double>, label long")
    got = np.array([r.v for r in stats.silhouette_samples(points, metric).orderBy("row").collect()])
    assert np.allclose(got, _brute(x, labels, metric), rtol=1e-9, atol=1e-11)
    one = stats.silhouette_samples(points.where("label = 1"), metric)
    assert {r.v for r in one.collect()} == {None}


def test_pairs_move_in_blocks(spark):
    """A point is in one row of a block and is not repeated by itself for every other block."""
    from tessera.plans import grid

    points = spark.range(1300).selectExpr("id row", "array(double(id)) vec", "id % 3 label")
    p = grid.packed(points, 4, "label")
    assert p.count() == 4 and sum(r.n for r in p.select("n").collect()) == 1300
    assert grid.block_count(600_000, 32_768) == 19 and grid.block_count(100_000, 32_768) == 10 and grid.block_count(3, 32_768) == 1


def _order(x, i):
    d = ((x - x[i]) ** 2).sum(axis=1)
    d[i] = np.inf
    return np.lexsort((np.arange(len(x)), d))


def test_neighbours_by_blocks(spark, monkeypatch):
    """Three blocks and copies: nearest and trustworthiness against brute force, equal distances by row."""
    rng = np.random.default_rng(32)
    x = np.round(rng.standard_normal((700, 6)), 1) + 100
    x[20:60], x[300:340] = x[20], x[500:540]
    monkeypatch.setattr(stats, "BLOCK", 256)
    frame = lambda m: spark.createDataFrame(list(enumerate(m.tolist())), "row long, vec array<double>")
    k, n, low = 5, len(x), x[:, :2].copy()
    got = stats.nearest(frame(low), k).orderBy("row", "rank").collect()
    near = np.array([_order(low, i)[:k] for i in range(n)])
    assert [r.other for r in got] == near.ravel().tolist()
    place = [np.argsort(_order(x, i)) for i in range(n)]
    ranks = np.array([place[i][near[i]] + 1 for i in range(n)])
    want = 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, ranks - k).sum()
    assert stats.trustworthiness(frame(x), frame(low), k).first().v == pytest.approx(want, abs=1e-14)


def test_nearest_of_few_far_and_unknown(spark):
    rows = [(0, [1e9, 0.0]), (1, [1e9, 1.0]), (2, [1e9, 3.0]), (3, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "row long, vec array<double>")
    assert [tuple(r) for r in stats.nearest(df, 5).orderBy("row", "rank").collect()] == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 1, 1), (2, 0, 2)]


def _spiked(spark, n, spikes):
    """Small diagonal with a few large cells in the first, a middle and the last block."""
    small = spark.range(n).selectExpr("id row", "id col", "(id % 7) / 10D val")
    return small.unionByName(spark.createDataFrame(spikes, "row long, col long, val double")).groupBy("row", "col").agg({"val": "sum"}).toDF("row", "col", "val")


def test_solvers_keep_vectors_off_the_driver(spark, monkeypatch):
    """Three blocks of rows; no array as long as the matrix goes to tasks or comes back."""
    n = 2 * panels.BLOCK + 5000
    cells = _spiked(spark, n, [(5, 5, 100.0), (40_000, 40_000, -90.0), (n - 1, n - 1, 80.0), (7, n - 2, 30.0), (n - 2, 7, 30.0)])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("a broadcast"))
    w, v = linalg.eigsh_frame(cells, n, 3, "LM")
    assert np.allclose(w, [-90.0 + 40_000 % 7 / 10, 80.0 + (n - 1) % 7 / 10, 100.5], rtol=1e-9)
    x = v.toPandas().sort_values(["k", "i"])["x"].to_numpy().reshape(3, n)
    assert np.allclose(x @ x.T, np.eye(3), atol=1e-9) and x[0, 40_000] == pytest.approx(1) and x[1, n - 1] == pytest.approx(1) and x[2, 5] == pytest.approx(1)
    s = linalg.svds(cells, n, n, 3, n_oversamples=5, n_power_iters=4, return_singular_vectors=False)
    assert np.allclose(s, [100.5, abs(w[0]), w[1]], rtol=1e-6)


def test_lanczos_of_small_and_split_matrices(spark):
    """Fewer rows than columns of the basis, invariant subspaces, and no cells."""
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 1, 2.0), (2, 2, 5.0), (3, 4, 1.0), (4, 3, 1.0)], "row long, col long, val double")
    w, v = linalg.eigsh_frame(cells, 5, 3, "LA", v0=np.array([0.0, 0, 1, 0, 0]))
    assert np.allclose(w, [2, 2, 5]) and v.count() == 15
    assert np.allclose(linalg.eigsh_frame(cells, 5, 2, "SA")[0], [-1, 1])
    assert np.allclose(linalg.eigsh_frame(cells.where("row > 9"), 4, 2, "LM")[0], 0)


def test_weights_move_no_cells(spark):
    """Counts of columns go to all tasks whatever the session's own limit of broadcasts; null rows stay out of bm25, as before."""
    rows = [(i % 40, f"w{i * 7 % 11}", float(1 + i % 5)) for i in range(300)]
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in {(r, c): v for r, c, v in rows}.items()], "row long, col string, val double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (sparse.tfidf, sparse.bm25):
            plan = f(cells)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    one = spark.createDataFrame([(None, "w", 2.0), (1, "w", 3.0)], "row long, col string, val double")
    assert [r.row for r in sparse.bm25(one).collect()] == [1]


@pytest.mark.parametrize("few", [0, 30, 10_000])
def test_forest_ends_in_one_task(spark, monkeypatch, few):
    """The same forest by rounds, by rounds with one task at the end, and by one task alone, which takes few jobs."""
    rng = np.random.default_rng(33)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(-3, 4, 150))]
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    calls, components = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda *a: calls.append(1) or components(*a))
    got = sorted(tuple(r) for r in graph.minimum_spanning_forest(spark.createDataFrame(e, "src long, dst long, w double")).collect())
    root, want = list(range(60)), []
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in e}):
        if root[a] != root[b]:
            want.append((a, b, w))
            root = [root[b] if r == root[a] else r for r in root]
    assert got == sorted(want) and bool(calls) == (few < 100)
