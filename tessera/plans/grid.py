"""Comparisons of all points with all points, in packed blocks.

Points are dealt into blocks by a hash; a block is one row whose vectors are a single binary. A task
holds two blocks, so its memory does not grow with the points, and a block is shuffled once a pair of
blocks it takes part in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import spill

PACKED = "b int, n long, d long, rows binary, labels binary, vecs binary"


def block_count(n: int, most: int, least: int = 512, wanted: int = 10) -> int:
    """Blocks of at most about ``most`` points; fewer points are cut so that there are tasks for many cores."""
    return max(1, -(-n // most), min(wanted, n // least))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")


def matrix_of(column) -> np.ndarray:
    """The rows of an Arrow list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=float).reshape(len(flat), -1)


def vecs_of(r: dict) -> np.ndarray:
    return np.frombuffer(r["vecs"]).reshape(r["n"], r["d"])


def packed(points: DataFrame, blocks: int, label: str | None = None) -> DataFrame:
    """One row a block of ``(row, vec[, label])``, with points in the order of label and row, written to the shared folder."""

    def pack(t: pa.Table) -> pa.Table:
        rows, labels = (np.asarray(t[c], dtype="i8") for c in ("row", "label"))
        order = np.lexsort((rows, labels))
        x = matrix_of(t["vec"])[order]
        one = {"b": t["b"][0].as_py(), "n": len(rows), "d": x.shape[1], "rows": rows[order].tobytes(), "labels": labels[order].tobytes(), "vecs": x.tobytes()}
        return pa.Table.from_pylist([one], schema=_SCHEMA)

    p = points.select("row", "vec", (F.col(label) if label else F.lit(0)).cast("long").alias("label"), block_of(blocks).alias("b"))
    return spill(p.groupBy("b").applyInArrow(pack, PACKED), "blocks")


_SCHEMA = pa.schema([("b", pa.int32()), ("n", pa.int64()), ("d", pa.int64()), ("rows", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])


def compare(left: DataFrame, right: DataFrame | None, blocks: int, f: Callable[[dict, dict], pa.Table], kind: str) -> DataFrame:
    """f(block of left, block of right) of every pair; without ``right`` a block of left meets itself and those after it."""
    seq = F.sequence(F.lit(0), F.lit(blocks - 1))
    i, j = F.col("b"), F.col("other")
    a = left.withColumn("other", F.explode(seq if right is not None else F.sequence(F.col("b"), F.lit(blocks - 1))))
    b = (left if right is None else right).withColumn("other", F.explode(seq if right is not None else F.sequence(F.lit(0), F.col("b"))))
    a, b = a.withColumn("pair", i * blocks + j).withColumn("side", F.lit(0)), b.withColumn("pair", j * blocks + i).withColumn("side", F.lit(1))
    both = a.drop("other").unionByName(b.drop("other"), allowMissingColumns=True)
    pairs = blocks * blocks if right is not None else blocks * (blocks + 1) // 2

    def run(t: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in t.to_pylist()}
        return f(sides[0], sides[1]) if len(sides) == 2 else empty

    empty = pa.table({n: pa.array([], pa.binary() if k == "binary" else pa.int32() if k == "int" else pa.float64() if k == "double" else pa.int64()) for n, k in (c.split() for c in kind.split(", "))})
    return both.repartition(2 * pairs, "pair").groupBy("pair").applyInArrow(run, kind)


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None, step: int = 1 << 16) -> np.ndarray:
    """Squared distances of rows to rows (of those numbered i to those numbered j), summed over differences, which leaves copies at 0."""
    i, j = (np.arange(len(v)) if at is None else at for v, at in ((x, i), (y, j)))
    out = np.empty(len(i))
    for k in range(0, len(i), step):
        gap = x[i[k : k + step]] - y[j[k : k + step]]
        out[k : k + step] = (gap * gap).sum(axis=1)
    return out
