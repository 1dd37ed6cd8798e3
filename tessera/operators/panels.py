"""Products of sparse cells with tall vectors that stay in the shared folder.

Cells are packed once into chunks of whole rows. A vector, or a panel of few of them, is cut into
blocks of ``BLOCK`` rows, a file each; tasks read the blocks that their chunks touch. The driver gets
products of the small side only, so neither its memory nor the number of jobs grows with the rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import drop_path, new_path, spill

BLOCK = 1 << 15
CHUNK = 1 << 20
#: Bytes of partial blocks that a task holds before it sends them on.
HELD = 256 << 20
_BLOB = pa.schema([("j", pa.int64()), ("at", pa.binary()), ("v", pa.binary())])
_KIND = "j long, at binary, v binary"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:/')}")


def _write(folder: str, name: str, x: np.ndarray) -> None:
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    own = f"{at}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(x, dtype=float).tobytes())
    fs.move(own, f"{at}/{name}")


def _read(folder: str, name: str, width: int = 1) -> np.ndarray | None:
    """A block, or None where all of it is 0 and nothing was written."""
    fs, at = _open(folder)
    if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{at}/{name}") as f:
        return np.frombuffer(f.read()).reshape(-1, width)


class Panel:
    """n rows and ``width`` columns: files ``name-j`` of a folder times a small matrix, or, without a folder, normal values of a seed."""

    def __init__(self, n: int, width: int, folder: str | None = None, name: str = "x", by: np.ndarray | None = None, seed: int = 0):
        self.n, self.width, self.folder, self.name, self.by, self.seed = n, width, folder, name, by, seed

    def rows(self, j: int) -> int:
        return min(BLOCK, self.n - j * BLOCK)

    def block(self, j: int) -> np.ndarray:
        if self.folder is None:
            x = np.random.default_rng([self.seed, j]).standard_normal((self.rows(j), self.width))
        else:
            x = _read(self.folder, f"{self.name}-{j}", self.width)
            x = np.zeros((self.rows(j), self.width)) if x is None else x
        return x if self.by is None else x @ self.by


def blocks_of(n: int) -> int:
    return -(-n // BLOCK)


def pack_cells(cells: DataFrame) -> DataFrame:
    """Chunks of whole rows, about ``CHUNK`` cells each, in the shared folder; a row's cells never part."""
    cells = spill(cells.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("val").cast("double")), "cells")
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CHUNK))

    def chunk(r, c, v):
        rows, r = np.unique(r, return_inverse=True)
        cols, c = np.unique(c, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (rows, cols, r.astype("i4"), c.astype("i4"), v)], ["rows", "cols", "r", "c", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            n += batch.num_rows
            if n >= CHUNK:
                r, c, v = (np.concatenate(x) for x in zip(*held))
                cut = np.searchsorted(r, r[-1])
                if cut:
                    yield chunk(r[:cut], c[:cut], v[:cut])
                held, n = [[r[cut:], c[cut:], v[cut:]]], n - cut
        if n:
            yield chunk(*(np.concatenate(x) for x in zip(*held)))

    dealt = cells.repartitionByRange(parts, "row").sortWithinPartitions("row", "col")
    return spill(dealt.mapInArrow(run, "rows binary, cols binary, r binary, c binary, v binary"), "chunks")


def product(packed: DataFrame, x: Panel, out: Panel, gram: bool = False, against: list[Panel] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Writes A x, or A^T A x for ``gram``, as ``out``.

    Gives the R of out's QR factors and, for ``gram``, that of A x. With ``against``, columns, the
    first is their products with out, which is one column, and at the end its own with itself.
    """

    def fold(r, y):
        return np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")

    def run(batches):
        known, sums, r_y, size = {}, {}, None, 0

        def send():
            for j, total in sums.items():
                at = np.flatnonzero(total.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([at.astype("i4").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(total[:, at].T).tobytes()], pa.binary())], schema=_BLOB)

        for batch in batches:
            for row in batch.to_pylist():
                rows, cols = (np.frombuffer(row[c], "i8") for c in ("rows", "cols"))
                r, c, v = np.frombuffer(row["r"], "i4"), np.frombuffer(row["c"], "i4"), np.frombuffer(row["v"])
                some = np.empty((x.width, len(cols)))
                for j, a, b in _spans(cols):
                    if j not in known:
                        if len(known) * BLOCK * x.width * 8 > HELD:
                            known.clear()
                        known[j] = np.ascontiguousarray(x.block(j).T)
                    some[:, a:b] = known[j][:, cols[a:b] - j * BLOCK]
                y = np.array([np.bincount(r, v * q[c], len(rows)) for q in some])
                if gram:
                    r_y = fold(r_y, y.T)
                    y, rows = np.array([np.bincount(c, v * q[r], len(cols)) for q in y]), cols
                for j, a, b in _spans(rows):
                    if j not in sums:
                        sums[j] = np.zeros((x.width, out.rows(j)))
                        size += sums[j].nbytes
                    sums[j][:, rows[a:b] - j * BLOCK] += y[:, a:b]
                if size > HELD:
                    yield from send()
                    sums, size = {}, 0
        yield from send()
        if r_y is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""], pa.binary()), pa.array([r_y.tobytes()], pa.binary())], schema=_BLOB)

    def meet(t: pa.Table) -> pa.Table:
        j = t["j"][0].as_py()
        parts = zip((np.frombuffer(b, "i4") for b in t["at"].to_pylist()), (np.frombuffer(b).reshape(-1, x.width) for b in t["v"].to_pylist()))
        if j < 0:
            found = fold(None, np.vstack([v for _, v in parts]))
        else:
            total = np.zeros((out.rows(j), x.width))
            for at, v in parts:
                total[at] += v
            _write(out.folder, f"{out.name}-{j}", total)
            if against is None:
                found = fold(None, total)
            else:
                found = np.array([p.block(j)[:, 0] @ total[:, 0] for p in against] + [total[:, 0] @ total[:, 0]])
        return pa.Table.from_pylist([{"j": j, "at": b"", "v": found.tobytes()}], schema=_BLOB)

    stats = packed.mapInArrow(run, _KIND).groupBy("j").applyInArrow(meet, _KIND).toArrow().sort_by("j").to_pylist()
    if against is not None:
        return sum((np.frombuffer(s["v"]) for s in stats), np.zeros(len(against) + 1)), None
    factors = [(s["j"], np.frombuffer(s["v"]).reshape(-1, x.width)) for s in stats]
    of_out = [f for j, f in factors if j >= 0]
    of_y = [f for j, f in factors if j < 0]
    return (fold(None, np.vstack(of_out)) if of_out else np.zeros((0, x.width))), (of_y[0] if of_y else np.zeros((0, x.width)))


def _spans(numbers: np.ndarray):
    """(block, first, end) of ascending numbers."""
    of = numbers // BLOCK
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    return zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)])


def over_blocks(spark: SparkSession, n: int, f) -> list[np.ndarray]:
    """f(block number), an array each, in order."""

    def run(batches):
        for batch in batches:
            for j in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([b""], pa.binary()), pa.array([np.asarray(f(j), dtype=float).tobytes()], pa.binary())], schema=_BLOB)

    found = _numbers(spark, n).mapInArrow(run, _KIND).toArrow().sort_by("j").to_pylist()
    return [np.frombuffer(r["v"]) for r in found]


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    blocks = blocks_of(n)
    return spark.range(0, blocks, 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism)))


def singular_values(packed: DataFrame, n_cols: int, width: int, n_power_iters: int, seed: int) -> np.ndarray:
    """Of the randomised range of ``width`` columns after the power iterations, which pass over the cells once each."""
    spark = packed.sparkSession
    x = Panel(n_cols, width, seed=seed)
    for last in [False] * n_power_iters + [True]:
        out = Panel(n_cols, width, new_path(spark, "panel"))
        r, r_y = product(packed, x, out, gram=True)
        if x.folder:
            drop_path(spark, x.folder)
        if last:
            drop_path(spark, out.folder)
            return np.linalg.svd(r @ _pinv(r_y), compute_uv=False)
        out.by = _pinv(r)
        x = out


def _pinv(r: np.ndarray) -> np.ndarray:
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    some = s > 1e-14 * max(s.max(initial=0), 1e-300)
    return (vt.T[:, some] / s[some]) @ u.T[some] if len(s) else np.zeros(r.shape[::-1])


class Basis:
    """Tall columns in the shared folder with their products ``s`` among themselves."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.folder, self.columns, self.s = spark, n, new_path(spark, "basis"), [], np.zeros((0, 0))

    def panel(self) -> Panel:
        return Panel(self.n, 1, self.folder, uuid.uuid4().hex)

    def append(self, source: Panel, c: np.ndarray, scale: float) -> float:
        """Adds scale * (source - columns * c), made orthogonal to the columns; its norm over scale, 0 if nothing is left of it."""
        left = 1.0 / scale
        for again in range(4):
            out, columns = self.panel(), self.columns

            def run(j):
                known = [p.block(j)[:, 0] for p in columns]
                u = source.block(j)[:, 0].copy()
                for x, y in zip(c, known):
                    u -= x * y
                u *= scale
                _write(out.folder, f"{out.name}-{j}", u)
                return [y @ u for y in known] + [u @ u]

            found = np.sum(over_blocks(self.spark, self.n, run), axis=0)
            h, size = found[:-1], np.sqrt(found[-1])
            if not size * left > 1e-12:
                return 0.0
            if not len(h) or np.abs(h / np.sqrt(np.diag(self.s))).max() <= 1e-12 * size and 1e-3 < size < 1e3:
                break
            if again == 3:
                break
            source, c, scale, left = out, np.linalg.solve(self.s, h), 1.0 / size, left * size
        self.s = np.block([[self.s, h[:, None]], [h[None, :], found[-1:][None, :]]])
        self.columns = [*self.columns, out]
        return size * left

    def turned(self, u: np.ndarray) -> Basis:
        """The columns times a small matrix."""
        new, columns = Basis(self.spark, self.n), self.columns
        out = [new.panel() for _ in range(u.shape[1])]

        def run(j):
            y = np.column_stack([p.block(j)[:, 0] for p in columns]) @ u
            for p, v in zip(out, y.T):
                _write(p.folder, f"{p.name}-{j}", v)
            return []

        over_blocks(self.spark, self.n, run)
        new.columns, new.s = out, u.T @ self.s @ u
        return new

    def frame(self) -> DataFrame:
        """``(k, i, x)`` of the columns; each column's entry of largest size is positive."""
        columns = self.columns

        def lead(j):
            y = np.array([p.block(j)[:, 0] for p in columns])
            return y[np.arange(len(y)), np.abs(y).argmax(axis=1)]

        top = np.array(over_blocks(self.spark, self.n, lead))
        sign = np.where(top[np.abs(top).argmax(axis=0), np.arange(len(columns))] < 0, -1.0, 1.0)

        def run(batches):
            for batch in batches:
                for j in batch.column(0).to_pylist():
                    for k, p in enumerate(columns):
                        v = p.block(j)[:, 0] * sign[k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(np.arange(len(v)) + j * BLOCK), pa.array(v)], ["k", "i", "x"])

        return _numbers(self.spark, self.n).mapInArrow(run, "k long, i long, x double")


def lanczos(times, spark: SparkSession, n: int, k: int, which: str, ncv: int, maxiter: int, tol: float, seed: int, start: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame]:
    """k eigenvalues, ascending, and ``(k, i, x)`` of their vectors, by Lanczos with full re-orthogonalisation and thick restarts.

    ``times(x, out, against)`` is the matrix's product. The small problem counts what the columns' own
    products differ from 1 and 0.
    """
    basis, h = Basis(spark, n), np.zeros((0, 0))
    first = Panel(n, 1, seed=seed)
    if start is not None:
        shared = np.asarray(start, dtype=float)
        first = Basis(spark, n).panel()
        over_blocks(spark, n, lambda j: _write(first.folder, f"{first.name}-{j}", shared[j * BLOCK : (j + 1) * BLOCK]) or [])
    basis.append(first, np.zeros(0), n**-0.5)
    for _ in range(maxiter):
        rest = 0.0
        while True:
            m = len(basis.columns)
            w = basis.panel()
            found = times(basis.columns[-1], w, basis.columns)
            h = np.block([[h, found[: m - 1, None]], [found[None, :m]]])
            c = np.linalg.solve(basis.s, found[:m])
            size = np.sqrt(max(found[m] - 2 * c @ found[:m] + c @ basis.s @ c, 1e-16 * found[m], 1e-300))
            if m >= n:
                break
            rest = basis.append(w, c, 1 / size) if found[m] > 0 else 0.0
            if not rest:
                for more in range(3):  # an invariant subspace: on with any vector outside it
                    if basis.append(Panel(n, 1, seed=seed + (m + 1) * 3 + more), np.zeros(m), n**-0.5):
                        break
                else:
                    break
            if m >= ncv:
                break
        lower = np.linalg.inv(np.linalg.cholesky(basis.s[:m, :m]))
        theta, u = np.linalg.eigh(lower @ ((h + h.T) / 2) @ lower.T)
        u = lower.T @ u
        rank = {"LA": -theta, "SA": theta, "LM": -np.abs(theta), "SM": np.abs(theta)}[which]
        order = np.argsort(rank, kind="stable")
        best = order[:k]
        done = m >= n or len(basis.columns) == m or (rest * np.abs(u[-1, best]) <= tol * max(1.0, np.abs(theta).max())).all()
        last = basis.columns[m:]
        cross = basis.s[:m, m:]
        own = basis.s[m:, m:]
        keep = best if done else order[: min(len(order) - 1, k + (ncv - k) // 2)]
        keep = keep[np.argsort(theta[keep])] if done else keep
        old, basis.columns, basis.s = basis.folder, basis.columns[:m], basis.s[:m, :m]
        basis, h = basis.turned(u[:, keep]), np.diag(theta[keep])
        if done:
            drop_path(spark, old)
            return theta[keep], basis.frame()
        # the residual, which is orthogonal to the columns kept, goes on
        basis.append(last[0], np.linalg.solve(basis.s, u[:, keep].T @ cross[:, 0]), 1 / np.sqrt(own[0, 0]))
        drop_path(spark, old)
    raise RuntimeError(f"no {k} eigenvalues after {maxiter} restarts")
