"""Dense products and factorisations.

What grows with the rows is distributed: products are joins and sums, and everything spectral goes
through the D x D Gram matrix, which each task sums for its rows in one array. Only D x D arrays
and iteration vectors of the smaller dimension reach the driver; ``MOST`` bounds D.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panels

MOST = 8192


def gemm(x: DataFrame, y: DataFrame, alpha: float = 1.0, z: DataFrame | None = None, beta: float = 0.0, trans_x: bool = False, trans_y: bool = False) -> DataFrame:
    """alpha * X * Y + beta * Z of cells; ``trans_x`` and ``trans_y`` use the transposed matrices."""
    from tessera.operators.sparse import spmm, transpose

    return spmm(transpose(x) if trans_x else x, transpose(y) if trans_y else y, alpha, z, beta)


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0, trans: bool = False) -> DataFrame:
    """alpha * A * x + beta * y with ``(i, v)`` vectors; ``trans`` uses A transposed."""
    by, on = ("col", "row") if trans else ("row", "col")
    out = a.join(x.select(F.col("i").alias(on), "v"), on).groupBy(F.col(by).alias("i")).agg((F.lit(alpha) * F.sum(F.col("val") * F.col("v"))).alias("v"))
    if y is None:
        return out
    both = out.unionByName(y.select("i", (F.lit(beta) * F.col("v")).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def _sums(rows: DataFrame, extra: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of rows, sum of outer products); with ``extra`` that column is appended to each row."""
    columns = ["vec"] + ([extra] if extra else [])

    def run(batches):
        n, s, g = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            if extra:
                x = np.column_stack([x, np.asarray(batch.column(1))])
            s, g = (x.sum(axis=0), x.T @ x) if g is None else (s + x.sum(axis=0), g + x.T @ x)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], ["n", "s", "g"])

    def merge(batches):
        n, s, g = 0, 0.0, 0.0
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, s, g = n + a, s + np.frombuffer(b), g + np.frombuffer(c)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], ["n", "s", "g"])

    kind = "n long, s binary, g binary"
    parts = rows.select(*columns).mapInArrow(run, kind)
    parts = parts.coalesce(16).mapInArrow(merge, kind)  # few D x D arrays reach the driver
    n, s, g = 0, np.zeros(0), np.zeros(0)
    for r in parts.toLocalIterator():
        a, b = np.frombuffer(bytes(r.s)), np.frombuffer(bytes(r.g))
        n, s, g = n + r.n, (a if not n else s + a), (b if not n else g + b)
    if len(s) > MOST:
        raise ValueError(f"{len(s)} columns; the Gram matrix of more than {MOST} isn't built")
    return n, s, g.reshape(len(s), len(s))


def _triangle(rows: DataFrame, extra: str | None = None) -> np.ndarray:
    """R of the QR factors of all rows, with ``extra`` appended to each, by a tree of small factorisations.

    A task stacks its rows below the R it has and factorises again, so it holds one D x D array; no
    products of columns are formed, so no digits are lost to them.
    """
    columns = ["vec"] + ([extra] if extra else [])

    def more(r, x):
        return np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")

    def run(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                r = more(r, np.column_stack([x, np.asarray(batch.column(1))]) if extra else x)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.shape[1]]), pa.array([r.tobytes()], pa.binary())], ["d", "r"])

    def merge(batches):
        r, d = None, 0
        for batch in batches:
            for d, raw in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                r = more(r, np.frombuffer(raw).reshape(-1, d))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([r.tobytes()], pa.binary())], ["d", "r"])

    kind = "d long, r binary"
    r = None
    for x in rows.select(*columns).mapInArrow(run, kind).coalesce(16).mapInArrow(merge, kind).toLocalIterator():
        if x.d > MOST:
            raise ValueError(f"{x.d} columns; a factor of more than {MOST} isn't built")
        r = more(r, np.frombuffer(bytes(x.r)).reshape(-1, x.d))
    if r is None:
        return np.zeros((0, 0))
    d = r.shape[1]
    r = np.vstack([r, np.zeros((max(0, d - len(r)), d))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def gram_cells(rows: DataFrame, centred: bool, divisor: Callable[[int], float] = lambda n: 1) -> DataFrame:
    n, s, g = _sums(rows)
    out = (g - np.outer(s, s) / n if centred else g) / divisor(n)
    d = len(s)
    r, c = np.divmod(np.arange(d * d), max(d, 1))
    return rows.sparkSession.createDataFrame(pa.table({"row": r, "col": c, "val": out.ravel()}))


def _fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns whose entry of largest size is positive."""
    lead = np.abs(vectors).argmax(axis=0)
    sign = np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return vectors * sign


def project(rows: DataFrame, matrix: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """Rows times a small matrix, as ``(row, vec)``; the matrix is broadcast with the task."""
    m, s = np.asarray(matrix), shift

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                y = (x - s if s is not None else x) @ m
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["row", "vec"])

    return rows.select("row", "vec").mapInArrow(run, "row long, vec array<double>")


def eig(matrix: np.ndarray, largest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues ascending and vectors as columns of a symmetric matrix; ``largest`` keeps that many."""
    w, v = np.linalg.eigh(matrix)
    return (w[-largest:], v[:, -largest:]) if largest else (w, v)


def to_matrix(cells: DataFrame, n_rows: int, n_cols: int) -> np.ndarray:
    """A small matrix on the driver; ``MOST`` bounds its sides."""
    if max(n_rows, n_cols) > MOST:
        raise ValueError("too large for the driver")
    t = cells.select("row", "col", "val").toArrow()
    out = np.zeros((n_rows, n_cols))
    out[np.asarray(t["row"]), np.asarray(t["col"])] = np.asarray(t["val"])
    return out


def svd(rows: DataFrame, k: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``(U rows, singular values descending, V)`` of a tall matrix, from those of the R of its QR factors.

    Columns of U that belong to a singular value of 0 are 0.
    """
    _, s, vt = np.linalg.svd(_triangle(rows))
    s, v = s[: k or len(s)], _fixed_sign(vt.T[:, : k or len(s)])
    inverse = _inverse(s, 1e-14)
    return project(rows, v * inverse), s, v


def qr(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Thin QR of a tall matrix by a tree of factorisations; R has no negative diagonal.

    Q is the rows times the inverse of R, done twice, so that it is orthonormal to the last digits.
    Where columns depend on each other the inverse is a pseudo-inverse: Q R still gives the rows, and
    Q has orthonormal rows of a lower rank.
    """
    r_all = None
    q = rows
    for _ in range(2):
        r = _triangle(q)
        u, s, vt = np.linalg.svd(r)
        q = project(q, (vt.T * _inverse(s, 1e-12)) @ u.T)
        r_all = r if r_all is None else r @ r_all
    return q, r_all


def _inverse(s: np.ndarray, eps: float) -> np.ndarray:
    """1 / s, and 0 where s is at most ``eps`` times the largest."""
    some = s > eps * max(s.max(initial=0), 1e-300)
    return np.where(some, 1 / np.where(some, s, 1), 0)


def rsvd(rows: DataFrame, k: int, oversample: int = 10, power: int = 2, seed: int = 5) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Randomised SVD of rank k: a random range is refined by passes over the rows, then solved small."""
    first = rows.select("vec").first()
    if first is None:
        return rows.select("row", "vec"), np.zeros(0), np.zeros((0, 0))
    d = len(first["vec"])
    width = min(d, k + oversample)
    v = np.random.default_rng(seed).standard_normal((d, width))
    for _ in range(power + 1):
        v, _ = np.linalg.qr(_gram_times(rows, v))
    _, _, g = _sums(project(rows, v))
    w, u = eig(g)
    order = np.argsort(-w)[:k]
    s, right = np.sqrt(np.maximum(w[order], 0)), _fixed_sign(v @ u[:, order])
    return project(rows, right / np.where(s > 0, s, 1)), s, right


def _gram_times(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """A^T (A v) in one pass, one D x k array a task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                part = x.T @ (x @ v)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts = rows.select("vec").mapInArrow(run, "g binary")
    return sum((np.frombuffer(bytes(r.g)) for r in parts.toLocalIterator()), np.zeros(v.size)).reshape(v.shape)


def cholesky_update(lower: np.ndarray, column: np.ndarray, eps: float = -1.0) -> np.ndarray:
    """The factor of an (n-1) square matrix grown by one row and column; ``eps`` >= 0 replaces a bad diagonal."""
    n = len(column)
    out = np.zeros((n, n))
    out[: n - 1, : n - 1] = lower
    left = np.linalg.solve(lower, column[:-1]) if n > 1 else np.zeros(0)
    out[n - 1, : n - 1] = left
    rest = column[-1] - left @ left
    d = np.sqrt(rest) if rest >= 0 else np.nan
    if eps >= 0 and not d >= eps:
        d = eps
    if not d > 0:
        raise ValueError("the grown matrix isn't positive definite")
    out[n - 1, n - 1] = d
    return out


def lstsq(rows: DataFrame, target: str = "y", eps: float = 1e-10, method: str = "svd") -> np.ndarray:
    """Least-squares weights of ``(vec, y)``.

    ``method``: svd or qr, both from the R of the rows with their targets (qr solves the triangle and
    needs independent columns), or eig for the normal equations. Small singular values, and
    eigenvalues, count as 0; no rows give no weights.
    """
    if method in ("svd", "qr"):
        r = _triangle(rows, target)
        if not len(r):
            return np.zeros(0)
        a, y = r[:-1, :-1], r[:-1, -1]
        if method == "qr":
            if np.abs(np.diag(a)).min() <= 1e-14 * np.abs(np.diag(a)).max():
                raise ValueError("columns depend on each other; use svd")
            return np.linalg.solve(a, y)
        u, s, vt = np.linalg.svd(a)
        return vt.T @ (_inverse(s, eps) * (u.T @ y))
    if method != "eig":
        raise ValueError("method is svd, qr or eig")
    _, _, g = _sums(rows, target)
    w, v = eig(g[:-1, :-1])
    return v @ (np.where(w > eps * max(w.max(), 1e-300), 1 / np.where(w > 0, w, 1), 0) * (v.T @ g[:-1, -1]))


def pca(rows: DataFrame, k: int, whiten: bool = False) -> dict:
    """Fitted principal components (rows), explained variances and ratios, singular values, mean, noise variance."""
    n, s, g = _sums(rows)
    w, v = eig((g - np.outer(s, s) / n) / (n - 1))
    w, v = np.maximum(w[::-1], 0), _fixed_sign(v[:, ::-1])
    d = len(w)
    out = {"mean": s / n, "components": v[:, :k].T, "explained_var": w[:k], "explained_var_ratio": w[:k] / w.sum(), "singular_vals": np.sqrt(w[:k] * (n - 1)), "noise_var": w[k:].mean() if k < min(d, n) else 0.0, "n": n}
    if whiten:
        out["components"] = out["components"] * (np.sqrt(n - 1) / out["singular_vals"])[:, None]
    return out


def pca_transform(rows: DataFrame, fit: dict) -> DataFrame:
    return project(rows, fit["components"].T, fit["mean"])


def tsvd(rows: DataFrame, k: int) -> dict:
    """Truncated SVD without centring; explained variances are those of the transformed columns, over n."""
    n, s, g = _sums(rows)
    w, v = eig(g)
    w, v = np.maximum(w[::-1], 0), _fixed_sign(v[:, ::-1])
    v = v[:, :k]
    mean = s / n
    var = np.diag(v.T @ g @ v) / n - (mean @ v) ** 2
    total = (np.diag(g) / n - mean**2).sum()
    return {"components": v.T, "singular_vals": np.sqrt(w[:k]), "explained_var": var, "explained_var_ratio": var / total}


# sparse solvers: the matrix stays in its DataFrame, vectors of the smaller side are on the driver


class SparseOperator:
    """Products of sparse cells ``(row, col, val)`` with blocks of vectors.

    Each product is one pass over the cells. A block in the shared folder (``panels.Panel``) stays
    there; an array goes to all tasks and each sends one sum, and ``most`` bounds its length. Only who
    asks for it with ``local_cells`` has a matrix of up to so many cells, which are counted first,
    fetched once, for iterations in numpy.
    """

    def __init__(self, cells: DataFrame, n_rows: int, n_cols: int, most: int = 5_000_000, local_cells: int = 0):
        self.cells, self.shape, self.local, self.most, self._packed = cells.select("row", "col", "val"), (n_rows, n_cols), None, most, None
        if self.cells.limit(local_cells + 1).count() <= local_cells:
            t = self.cells.toArrow()
            self.local = tuple(np.asarray(t[c]) for c in ("row", "col", "val"))

    @property
    def packed(self) -> DataFrame:
        """The cells in chunks of whole rows, made once."""
        if self._packed is None:
            self._packed = panels.pack_cells(self.cells)
        return self._packed

    def times(self, x, trans: bool = False):
        """A x, or A^T x, of an array; of ``(x, out, columns)``, panels, the products of the columns and of A x with A x, which is written as out."""
        if isinstance(x, tuple):
            return panels.product(self.packed, x[0], x[1], against=x[2])[0]
        if self.local is not None:
            r, c, v = self.local
            r, c = (c, r) if trans else (r, c)
            x = x.reshape(len(x), -1)
            out = np.zeros((self.shape[1] if trans else self.shape[0], x.shape[1]))
            np.add.at(out, r, v[:, None] * x[c])
            return out
        if max(self.shape) > self.most:
            raise ValueError(f"vectors of more than {self.most} entries aren't kept on the driver")
        n = self.shape[1] if trans else self.shape[0]
        x = x.reshape(len(x), -1)
        shared = self.cells.sparkSession.sparkContext.broadcast(x)

        def run(batches):
            total = np.zeros((n, shared.value.shape[1]))
            for batch in batches:
                r, c, v = (np.asarray(batch.column(i)) for i in range(3))
                if trans:
                    r, c = c, r
                np.add.at(total, r, v[:, None] * shared.value[c])
            some = np.flatnonzero(total.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([some.astype("<i8").tobytes()], pa.binary()), pa.array([total[some].tobytes()], pa.binary())], ["at", "v"])

        out = np.zeros((n, x.shape[1]))
        for r in self.cells.mapInArrow(run, "at binary, v binary").toLocalIterator():
            at = np.frombuffer(bytes(r["at"]), "<i8")
            out[at] += np.frombuffer(bytes(r.v)).reshape(len(at), -1)
        shared.unpersist()
        return out


def eigsh_frame(cells: DataFrame, n: int, k: int = 6, which: str = "LM", v0: np.ndarray | None = None, ncv: int | None = None, maxiter: int | None = None, tol: float = 0.0, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """As :func:`eigsh`, with vectors as ``(k, i, x)``, which never reach the driver."""
    if which not in ("LA", "SA", "LM", "SM") or not 1 <= k <= n:
        raise ValueError("which is LA, SA, LM or SM, and 1 <= k <= n")
    a = SparseOperator(cells, n, n)
    a.local = None  # a matrix without cells too
    ncv = min(n, ncv or max(2 * k + 1, 20))
    tol = tol or np.finfo(float).eps ** 0.5 * 1e-2
    return panels.lanczos(lambda x, out, columns: a.times((x, out, columns)), cells.sparkSession, n, k, which, ncv, maxiter or 10 * n, tol, seed, v0)


def eigsh(cells: DataFrame, n: int, k: int = 6, which: str = "LM", v0: np.ndarray | None = None, ncv: int | None = None, maxiter: int | None = None, tol: float = 0.0, seed: int = 0, local_cells: int = 0):
    """k eigenpairs of a symmetric sparse matrix by Lanczos with full re-orthogonalisation and thick restarts.

    ``which``: LA, SA, LM or SM. Values come in ascending order, vectors as columns.
    """
    if which not in ("LA", "SA", "LM", "SM") or not 1 <= k <= n:
        raise ValueError("which is LA, SA, LM or SM, and 1 <= k <= n")
    a = SparseOperator(cells, n, n, local_cells=local_cells)
    ncv = min(n, ncv or max(2 * k + 1, 20))
    tol = tol or np.finfo(float).eps ** 0.5 * 1e-2
    start = v0 if v0 is not None else np.random.default_rng(seed).standard_normal(n)
    basis = np.zeros((n, 0))
    image = np.zeros((n, 0))
    v = start / np.linalg.norm(start)
    for _ in range(maxiter or 10 * n):
        while basis.shape[1] < ncv:
            basis = np.column_stack([basis, v])
            w = a.times(v)[:, 0]
            image = np.column_stack([image, w])
            for _ in range(2):
                w = w - basis @ (basis.T @ w)
            size = np.linalg.norm(w)
            if size < 1e-12:
                w = np.random.default_rng(seed + basis.shape[1]).standard_normal(n)
                w -= basis @ (basis.T @ w)
                size = np.linalg.norm(w)
                if basis.shape[1] >= n or size < 1e-12:
                    break
            v = w / size
        small = basis.T @ image
        theta, u = np.linalg.eigh((small + small.T) / 2)
        rank = {"LA": -theta, "SA": theta, "LM": -np.abs(theta), "SM": np.abs(theta)}[which]
        order = np.argsort(rank, kind="stable")
        best = order[:k]
        vectors = basis @ u[:, best]
        gap = np.linalg.norm(image @ u[:, best] - vectors * theta[best], axis=0)
        if basis.shape[1] >= n or (gap <= tol * np.maximum(1.0, np.abs(theta).max())).all():
            break
        keep = order[: min(len(order) - 1, k + (ncv - k) // 2)]
        residual = image @ u[:, best[:1]] - vectors[:, :1] * theta[best[0]]
        basis, image = basis @ u[:, keep], image @ u[:, keep]
        v = residual[:, 0] - basis @ (basis.T @ residual[:, 0])
        v /= np.linalg.norm(v)
    up = np.argsort(theta[best])
    return theta[best][up], _fixed_sign(vectors[:, up])


def svds(cells: DataFrame, n_rows: int, n_cols: int, k: int = 6, n_oversamples: int = 10, n_power_iters: int = 2, seed: int = 0, return_singular_vectors: bool | str = True, local_cells: int = 0):
    """Randomised SVD of a sparse matrix: ``(U, s descending, V^T)``, or what is asked for of it.

    Values alone need no vectors on the driver: both sides stay in the shared folder.
    """
    if not 1 <= k < min(n_rows, n_cols):
        raise ValueError("1 <= k < min(shape)")
    a = SparseOperator(cells, n_rows, n_cols, local_cells=local_cells)
    if a.local is None and return_singular_vectors is False:
        return panels.singular_values(a.packed, n_cols, min(k + n_oversamples, n_rows, n_cols), n_power_iters, seed)[:k]
    q = np.random.default_rng(seed).standard_normal((n_cols, min(k + n_oversamples, min(n_rows, n_cols))))
    y, _ = np.linalg.qr(a.times(q))
    for _ in range(n_power_iters):
        z, _ = np.linalg.qr(a.times(y, trans=True))
        y, _ = np.linalg.qr(a.times(z))
    b = a.times(y, trans=True)
    v, s, ut = np.linalg.svd(b, full_matrices=False)
    u = y @ ut.T
    lead = np.abs(u).argmax(axis=0)
    sign = np.where(u[lead, np.arange(u.shape[1])] < 0, -1.0, 1.0)
    u, v, s = (u * sign)[:, :k], (v * sign)[:, :k], s[:k]
    if return_singular_vectors is False:
        return s
    return (u if return_singular_vectors in (True, "u") else None), s, (v.T if return_singular_vectors in (True, "vh") else None)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Callable", "Column", "DataFrame", "F", "SparkSession", "annotations", "np", "pa", "panels")]
