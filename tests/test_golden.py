"""Results on generated inputs against numpy and brute force, and edge cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import elementwise as fn
from tessera.operators import dense, graph, labels, linalg, rand, sparse, stats
from tessera.operators.components import connected_components

NAN = float("nan")


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def matrix(spark, m):
    return frame(spark, "row long, vec array<double>", [(i, [float(x) for x in r]) for i, r in enumerate(m)])


def csr(spark, indptr, idx, vals):
    return frame(spark, "row long, cols array<long>, vals array<double>", [(i, idx[a:b], [float(v) for v in vals[a:b]]) for i, (a, b) in enumerate(zip(indptr[:-1], indptr[1:]))])


def drawn(seed, n_rows, n_cols, top=9):
    """Small whole numbers with repeats and zeros."""
    return np.random.default_rng(seed).integers(0, top, (n_rows, n_cols)).astype(float)


def as_csr(spark, m):
    """The cells of a matrix that are not 0, as CSR rows; rows without any are there too."""
    at = [np.flatnonzero(r) for r in m]
    return csr(spark, np.cumsum([0, *map(len, at)]).tolist(), [int(c) for r in at for c in r], [float(m[i, c]) for i, r in enumerate(at) for c in r])


def as_cells(spark, m):
    return frame(spark, "row long, col long, val double", [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))])


FIVE = [tuple(r) for r in drawn(11, 6, 7)]


@pytest.mark.parametrize("k", [1, 3, 7])
@pytest.mark.parametrize("smallest", [True, False])
def test_select_k(spark, k, smallest):
    x = np.array(FIVE)
    out = rows_of(dense.select_k(matrix(spark, FIVE), k, smallest).select("row", "vals", "idx"), "row")
    order = np.argsort(x if smallest else -x, axis=1, kind="stable")[:, :k]
    assert [r[2] for r in out] == order.tolist() and [r[1] for r in out] == np.take_along_axis(x, order, axis=1).tolist()
    named = matrix(spark, FIVE).withColumn("names", F.transform("vec", lambda v, i: F.concat(F.lit("c"), i)))
    assert [r[2] for r in rows_of(dense.select_k(named, k, smallest, "names"), "row")] == [[f"c{i}" for i in r] for r in order]


def test_select_k_nan_is_largest(spark):
    out = dense.select_k(matrix(spark, [[0.5, NAN, NAN, NAN, NAN]]), 3, smallest=False).first()
    assert all(math.isnan(v) for v in out.vals) and 0 not in out.idx
    assert dense.select_k(matrix(spark, [[NAN, math.inf, -math.inf]]), 3).first().idx == [2, 1, 0]


def test_shift(spark):
    x = drawn(12, 4, 5)
    vecs = lambda df: np.array([r[1] for r in rows_of(df, "row")])
    m = matrix(spark, x)
    assert (vecs(dense.shift_cols(m, 2, 7.5)) == np.hstack([np.full((4, 2), 7.5), x[:, :-2]])).all()
    assert (vecs(dense.shift_cols(m, 1, to_end=False)) == np.hstack([x[:, 1:], np.arange(4.0)[:, None]])).all()
    assert (vecs(dense.shift_cols(m, 2, matrix(spark, -x[:, :2]))) == np.hstack([-x[:, :2], x[:, :-2]])).all()
    assert (vecs(dense.shift_rows(m, 4, 1, 7.5)) == np.vstack([np.full((1, 5), 7.5), x[:-1]])).all()
    assert (vecs(dense.shift_rows(m, 4, 2, to_end=False)) == np.vstack([x[2:], np.full((1, 5), 2.0), np.full((1, 5), 3.0)])).all()
    assert (vecs(dense.shift_rows(m, 4, 2, matrix(spark, -x[:2]), to_end=False)) == np.vstack([x[2:], -x[:2]])).all()


def test_csr_norms(spark):
    x = drawn(13, 5, 6, 4) - 1
    got = {k: [r[1] for r in rows_of(sparse.csr_norm(as_csr(spark, x), k), "row")] for k in ("Linf", "L1", "L2")}
    assert got == {"Linf": np.abs(x).max(axis=1).tolist(), "L1": np.abs(x).sum(axis=1).tolist(), "L2": (x**2).sum(axis=1).tolist()}


@pytest.mark.parametrize("kind", ["max", "L1"])
def test_csr_row_normalize(spark, kind):
    x = drawn(14, 5, 6, 4)
    x[2] = 0
    by = x.max(axis=1) if kind == "max" else x.sum(axis=1)
    got = {(r[0], c): v for r in rows_of(sparse.csr_row_normalize(as_csr(spark, x), kind)) for c, v in zip(r[1], r[2])}
    assert got == {(i, j): x[i, j] / by[i] for i, j in zip(*np.nonzero(x))}


def test_max_duplicates(spark):
    rng = np.random.default_rng(15)
    cells = [(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 4, 40), rng.integers(0, 4, 40), rng.integers(-9, 9, 40))]
    want = {}
    for a, b, v in cells:
        want[a, b] = max(v, want.get((a, b), v))
    df = frame(spark, "row long, col long, val double", cells)
    assert {(a, b): v for a, b, v in rows_of(sparse.max_duplicates(df))} == want
    assert {(a, b): v for a, b, v in rows_of(sparse.max_duplicates(df, from_zero=True))} == {k: max(0.0, v) for k, v in want.items()}


def test_csr_slice_and_dense(spark):
    x = drawn(16, 6, 5, 3)
    m = as_csr(spark, x)
    assert [r[1] for r in rows_of(sparse.csr_to_dense(m, 5), "row")] == x.tolist()
    assert [r[1] for r in rows_of(sparse.csr_to_dense(sparse.csr_row_slice(m, 2, 4), 5), "row")] == x[2:5].tolist()
    assert rows_of(sparse.csr_to_coo(m), "row", "col") == [(i, j, x[i, j]) for i, j in zip(*np.nonzero(x))]


def test_packed_masks(spark):
    rng = np.random.default_rng(17)
    flags = rng.random((9, 21)) < 0.4
    flat = np.zeros(-(-flags.size // 32) * 32, bool)
    flat[: flags.size] = flags.ravel()
    words = [int(sum(1 << b for b in range(32) if w[b])) for w in flat.reshape(-1, 32)]
    want = list(zip(*map(lambda z: z.tolist(), np.nonzero(flags))))
    one = frame(spark, "words array<long>", [(words,)])
    many = frame(spark, "at long, word long", list(enumerate(words)))
    for packed in (one, many):
        assert rows_of(sparse.bitmap_cells(packed, 9, 21), "row", "col") == want
    a, b = rng.standard_normal((9, 4)), rng.standard_normal((21, 4))
    got = {(r, c): v for r, c, v in rows_of(sparse.masked_matmul(many, matrix(spark, a), matrix(spark, b), shape=(9, 21)))}
    assert set(got) == set(want) and all(v == pytest.approx((a @ b.T)[k]) for k, v in got.items())


def test_offsets_count_empty_rows(spark):
    cells = frame(spark, "row long, col long, val double", [(0, 1, 1.0), (0, 2, 1.0), (3, 0, 1.0)])
    assert [r[1] for r in rows_of(sparse.row_offsets(cells, spark, 5, 2), "row")] == [0, 2, 2, 2, 3]


def test_symmetrize(spark):
    x = drawn(18, 5, 5, 3)
    got = {(r, c): v for r, c, v in rows_of(sparse.symmetrize(as_cells(spark, x))) if v}
    assert got == {(i, j): (x + x.T)[i, j] for i, j in zip(*np.nonzero(x + x.T))}


def test_laplacian(spark):
    x = np.triu(drawn(19, 6, 6, 3), 1)
    x = x + x.T
    want = np.diag(x.sum(axis=1)) - x
    for loops in (0.0, 5.0):  # loops say nothing
        m = x.copy()
        m[0, 0] = loops
        out = {(r, c): v for r, c, v in rows_of(graph.laplacian(as_cells(spark, m))) if v}
        assert out == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want))}


def test_labels(spark):
    given_ = (np.random.default_rng(20).integers(0, 9, 30) ** 2 - 3).tolist()
    found, number = np.unique(given_, return_inverse=True)
    df = frame(spark, "i long, label long", list(enumerate(given_)))
    assert [r[1] for r in rows_of(labels.make_monotonic(df), "i")] == (number + 1).tolist()
    assert [r[0] for r in rows_of(labels.unique_labels(df), "label")] == found.tolist()
    assert [r[1] for r in rows_of(labels.one_vs_rest(df, int(found[2])), "i")] == np.where(number == 2, 1, -1).tolist()


MAX = 2**31 - 1


@pytest.mark.parametrize("seed", range(4))
def test_merge_labels(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.where(rng.random(25) < 0.2, MAX, rng.integers(1, 12, 25)) for _ in range(2))
    mask = rng.random(25) < 0.3
    least = {int(x): int(x) for x in [*a, *b]}
    for _ in range(30):  # the least label spreads until nothing changes
        for x, y, m in zip(a.tolist(), b.tolist(), mask):
            if m and MAX not in (x, y):
                low = min(least[x], least[y])
                least = {k: low if v in (least[x], least[y]) else v for k, v in least.items()}
    df = frame(spark, "i long, a long, b long, mask boolean", [(i, int(x), int(y), bool(m)) for i, (x, y, m) in enumerate(zip(a, b, mask))])
    assert [r[1] for r in rows_of(labels.merge_labels(df), "i")] == [least[x if x != MAX else y] for x, y in zip(a.tolist(), b.tolist())]


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    total = 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    return total


def test_mst_random_forest(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 70), rng.integers(0, 40, 70), rng.integers(-5, 6, 70))]
    out = rows_of(graph.minimum_spanning_forest(frame(spark, "src long, dst long, w double", e)))
    assert sum(r[2] for r in out) == pytest.approx(kruskal(e))


def test_components_of_chain_star_and_loops(spark):
    e = [(i, i + 1) for i in range(20, 60)] + [(7, i) for i in range(100, 160)] + [(3, 3)]
    out = dict(rows_of(connected_components(frame(spark, "src long, dst long", e))))
    assert all(out[i] == 20 for i in range(20, 61)) and all(out[i] == 7 for i in range(100, 160)) and out[3] == 3
    assert connected_components(frame(spark, "src long, dst long", [])).count() == 0


def test_eigenvalues(spark):
    x = drawn(21, 6, 6)
    m = x + x.T
    w, v = linalg.eig(m)
    assert np.allclose(m @ v, v * w) and np.allclose(v.T @ v, np.eye(6)) and np.trace(m) == pytest.approx(w.sum())


def test_factorisations(spark):
    x = np.random.default_rng(1).standard_normal((40, 5))
    m = matrix(spark, x)
    u, s, v = linalg.svd(m)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False))
    _, r = linalg.qr(m)
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(np.tril(r, -1), 0)
    fit = linalg.pca(m, 2)
    w, vectors = np.linalg.eigh(np.cov(x.T))
    w, vectors = w[::-1], vectors[:, ::-1]
    assert np.allclose(np.abs(np.sum(fit["components"].T * vectors[:, :2], axis=0)), 1)
    t = linalg.tsvd(m, 2)
    right = np.linalg.svd(x)[2][:2]
    assert np.allclose(np.abs(np.sum(t["components"] * right, axis=1)), 1) and np.allclose(t["singular_vals"], np.linalg.svd(x, compute_uv=False)[:2])
    ur, sr, vr = linalg.rsvd(m, 2, power=8)
    assert np.allclose(sr, t["singular_vals"], rtol=1e-4) and np.allclose(np.abs(np.sum(vr.T * right, axis=1)), 1, atol=1e-3)
    assert linalg.rsvd(m.where("row < 0"), 2)[0].count() == 0
    assert np.allclose(fit["explained_var"], w[:2]) and fit["noise_var"] == pytest.approx(w[2:].mean())
    a = np.array([[4.0, 2], [2, 3]])
    assert np.allclose(linalg.cholesky_update(np.array([[2.0]]), a[1]), np.linalg.cholesky(a))
    with pytest.raises(ValueError):
        linalg.cholesky_update(np.array([[1.0]]), np.array([2.0, 1.0]))


def test_factors_of_hard_matrices(spark):
    """Columns that nearly or wholly depend on each other, where products of columns lose all digits."""
    rng = np.random.default_rng(22)
    x = rng.standard_normal((60, 4))
    near = np.column_stack([x, x[:, 0] + 1e-9 * rng.standard_normal(60)])
    s = np.linalg.svd(near, compute_uv=False)
    assert np.allclose(linalg.svd(matrix(spark, near))[1], s, rtol=1e-4, atol=1e-13)
    y = near @ np.array([1.0, 2, 3, 4, 5])
    rows = frame(spark, "vec array<double>, y double", [(r.tolist(), float(v)) for r, v in zip(near, y)])
    for method in ("qr", "svd"):
        assert np.allclose(near @ linalg.lstsq(rows, eps=1e-14, method=method), y, atol=1e-8)
    whole = np.column_stack([x, x[:, 1]])
    q, r = linalg.qr(matrix(spark, whole))
    q = np.array([v[1] for v in rows_of(q, "row")])
    assert np.allclose(q @ r, whole)
    rows = frame(spark, "vec array<double>, y double", [(r.tolist(), float(v)) for r, v in zip(whole, y)])
    assert np.allclose(linalg.lstsq(rows), np.linalg.lstsq(whole, y, rcond=1e-10)[0])
    with pytest.raises(ValueError):
        linalg.lstsq(rows, method="qr")
    assert len(linalg.lstsq(rows.where("y > 1e9"))) == 0


def test_exact_median(spark):
    rng = np.random.default_rng(23)
    for x in (rng.standard_normal(501), rng.integers(0, 3, 400).astype(float), np.repeat(5.0, 300), np.array([1.0, 2.0]), rng.standard_normal(999) ** 9):
        df = frame(spark, "v double", [(float(v),) for v in x] + [(None,), (NAN,)])
        for most in (10, 100_000):
            assert stats.exact_median(df, most) == np.median(x)
    assert stats.exact_median(df.where("v > 1e300")) is None


@pytest.mark.parametrize("which,pick", [("LA", slice(-3, None)), ("SA", slice(0, 3))])
def test_eigsh(spark, which, pick):
    m = np.random.default_rng(2).standard_normal((30, 30))
    m = m + m.T
    cells = frame(spark, "row long, col long, val double", [(i, j, float(m[i, j])) for i in range(30) for j in range(30)])
    w, v = linalg.eigsh(cells, 30, 3, which, local_cells=1000)
    assert np.allclose(w, np.linalg.eigvalsh(m)[pick], atol=1e-6) and np.allclose(m @ v, v * w, atol=1e-4)
    op = linalg.SparseOperator(cells, 30, 30, local_cells=10)  # the distributed product
    assert np.allclose(op.times(v), m @ v) and np.allclose(op.times(v, trans=True), m.T @ v)


def test_scores_edge_cases(spark):
    one = lambda rows: stats.label_scores(frame(spark, "truth long, pred long", rows)).first()
    assert one([]).entropy_truth == 1.0 and one([]).adjusted_rand == 1.0
    assert one([(1, 2)]).rand_index == 1.0
    same = one([(0, 0)] * 5)
    assert same.homogeneity == 1.0 and same.v_measure == 1.0 and same.adjusted_rand == 1.0


def test_elementwise_edges(spark):
    df = frame(spark, "a double, b double", [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0)])
    got = [r[0] for r in df.select(fn.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2 and got[4] is None
    assert [r[0] for r in df.select(fn.divide_check_zero(F.col("a"), F.col("b"))).collect()][:4] == [0, 0, 0, 2]
    got = [r[0] for r in df.select(fn.log(F.col("a"))).collect()]
    assert math.isnan(got[1]) and got[2] == -math.inf
    assert rows_of(dense.normalize(matrix(spark, [[0, 0], [3, 4]])), "row") == [(0, None), (1, [0.6, 0.8])]
    assert rows_of(dense.arg_best(matrix(spark, [[1, 5, 5], [NAN, 2, 1], [NAN, NAN, NAN]]), True), "i") == [(0, 1), (1, 1), (2, 0)]


def test_silhouette_of_singletons(spark):
    p = frame(spark, "row long, vec array<double>, label long", [(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)])
    out = dict(rows_of(stats.silhouette_samples(p)))
    assert out[2] == 0.0 and out[0] == pytest.approx((81 - 1) / 81)


def test_generators_do_not_depend_on_partitions(spark):
    a = rows_of(rand.generate(spark, 100, "normal", 5, 0.0, 1.0), "i")
    b = rows_of(spark.range(0, 100, 1, 7).select(F.col("id").alias("i"), rand.draw("normal", F.col("id"), 5, 0.0, 1.0).alias("v")), "i")
    assert a == b


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.floats(-9, 9)), min_size=1, max_size=12, unique_by=lambda t: t[:2]))
def test_transpose_twice_and_norms(spark, cells):
    m = frame(spark, "row long, col long, val double", cells)
    assert sorted(rows_of(sparse.transpose(sparse.transpose(m)))) == sorted(cells)
    assert all(r[1] >= 0 for r in rows_of(sparse.csr_norm(sparse.coo_to_csr(m), "L1")))


def test_npy_round_trip(spark, tmp_path):
    from tessera.sources import npy

    npy.write_rows(matrix(spark, FIVE), f"{tmp_path}/m")
    assert [tuple(r[1]) for r in rows_of(npy.read_rows(spark, f"{tmp_path}/m"), "row")] == FIVE
    assert npy.scalar_from_bytes(npy.scalar_to_bytes(2.5)) == 2.5
    assert npy.read_header(npy.to_bytes(np.zeros((2, 3), "f4"))) == ((2, 3), False, np.dtype("f4"))
    with pytest.raises(ValueError):
        npy.from_bytes(npy.to_bytes(np.zeros(3)), (4,))


def test_bits(spark):
    from tessera.operators import bits

    packed = bits.from_indices(frame(spark, "i long", [(0,), (5,), (40000,), (5,)]))
    assert bits.count(packed).first().n == 3
    assert rows_of(bits.test(packed, frame(spark, "i long", [(0,), (1,), (5,), (40000,), (99999,)])), "i") == [(0, True), (1, False), (5, True), (40000, True), (99999, False)]
    flags = frame(spark, "i long, bit boolean", [(0, True), (1, False)])
    assert rows_of(bits.flip(flags), "i") == [(0, False), (1, True)]
    assert bits.repeat(flags, 3, 2).count() == 6
    assert rows_of(bits.set_bits(flags, frame(spark, "i long", [(1,)])), "i") == [(0, True), (1, True)]
