"""Sparse matrices as ``(row, col, val)`` cells (absent = 0) or as CSR rows ``(row, cols, vals)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.dense import norm_of
from tessera.plans.scratch import spill


def coo(cells: DataFrame, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Cells with one value a place, duplicates brought together by ``how``."""
    return cells.groupBy("row", "col").agg(how("val").alias("val"))


def coo_to_csr(cells: DataFrame) -> DataFrame:
    """Rows with ascending columns; rows without cells are absent."""
    packed = F.sort_array(F.collect_list(F.struct("col", "val")))
    return cells.groupBy("row").agg(packed.alias("__p")).select("row", F.transform("__p", lambda x: x["col"]).alias("cols"), F.transform("__p", lambda x: x["val"]).alias("vals"))


def csr_to_coo(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("x")).select("row", F.col("x.cols").alias("col"), F.col("x.vals").alias("val"))


def row_offsets(cells: DataFrame, spark: SparkSession, n_rows: int, block: int = 1 << 16) -> DataFrame:
    """``(row, start)``: cells before each row, empty rows included.

    Prefix sums in two levels: inside blocks of rows, and over the blocks.
    """
    counts = spark.range(n_rows).select(F.col("id").alias("row")).join(degree(cells), "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("row") / block).alias("b"))
    inside = Window.partitionBy("b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("b").agg(F.sum("n").alias("t")).select("b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"))
    return counts.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "b").select("row", (F.col("in") + F.col("ahead")).alias("start"))


def adj_to_csr(rows: DataFrame) -> DataFrame:
    """Boolean adjacency rows ``(row, flags)`` to the column numbers that are true."""
    at = F.filter(F.transform("flags", lambda f, i: F.when(f, i.cast("long"))), lambda x: x.isNotNull())
    return rows.select("row", at.alias("cols"))


def bits_to_index(words: Column, n_bits: int, width: int = 32) -> Column:
    """Positions of set bits in an array of packed words, lowest bit first."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.getbit(F.element_at(words, F.floor(i / width).cast("int") + 1), i % width) == 1)


def bitmap_cells(bitmap: DataFrame, n_rows: int, n_cols: int, width: int = 32) -> DataFrame:
    """``(row, col)`` of the set bits of a 2-D bitmap in row-major order.

    The bitmap is one table row of packed ``words``, or rows ``(at, word)``, of which a large one has
    many in many tasks. Only one word's bits are in memory at a time.
    """
    words = bitmap.select("at", "word") if "word" in bitmap.columns else bitmap.select(F.posexplode("words").alias("at", "word"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(F.col("word"), i) == 1))
    at = words.select("at", "word", bit.alias("bit")).select((F.col("at").cast("long") * width + F.col("bit")).alias("i")).where(F.col("i") < n_rows * n_cols)
    return at.select(F.floor(F.col("i") / n_cols).alias("row"), (F.col("i") % n_cols).cast("long").alias("col"))


def bitmap_to_csr(bitmap: DataFrame, n_rows: int, n_cols: int, width: int = 32) -> DataFrame:
    """A 2-D bitmap, see :func:`bitmap_cells`, to ``(row, cols)``."""
    return bitmap_cells(bitmap, n_rows, n_cols, width).groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("cols"))


def bitset_to_csr(spark: SparkSession, bitset: DataFrame, n_rows: int, n_bits: int, width: int = 32) -> DataFrame:
    """A 1-D bitset repeated for every row; the bitset is one table row."""
    at = bitset.select(F.transform(bits_to_index(F.col("words"), n_bits, width), lambda x: x.cast("long")).alias("cols"))
    return spark.range(n_rows).select(F.col("id").alias("row")).join(F.broadcast(at))


def csr_to_dense(rows: DataFrame, n_cols: int) -> DataFrame:
    """Arrays of n_cols values, 0 where a row has none."""
    at = F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long"))
    mapped = rows.withColumn("__m", F.map_from_arrays("cols", "vals"))
    return mapped.select("row", F.transform(at, lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0.0))).alias("vec"))


def coo_sort(cells: DataFrame, by_weight: bool = False) -> DataFrame:
    """Cells in order with their place; the range sort is distributed."""
    return cells.orderBy("val", "row", "col") if by_weight else cells.orderBy("row", "col")


def remove_scalar(cells: DataFrame, scalar: float = 0.0) -> DataFrame:
    return cells.where(F.col("val") != scalar)


def max_duplicates(cells: DataFrame, from_zero: bool = False) -> DataFrame:
    """The largest value of each place; ``from_zero`` never goes below 0."""
    top = F.greatest(F.max("val"), F.lit(0.0)) if from_zero else F.max("val")
    return cells.groupBy("row", "col").agg(top.alias("val"))


def csr_row_op(rows: DataFrame, f: Callable[[Column, Column], Column], name: str = "v") -> DataFrame:
    """f(cols, vals) of each row."""
    return rows.select("row", f(F.col("cols"), F.col("vals")).alias(name))


def csr_row_slice(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first to last, both included, numbered from 0 again."""
    return rows.where(F.col("row").between(first, last)).select((F.col("row") - first).alias("row"), "cols", "vals")


def degree(cells: DataFrame, not_equal: float | None = None) -> DataFrame:
    """Cells of each row, or those whose value differs from a scalar."""
    count = F.count("*") if not_equal is None else F.count_if(F.col("val") != not_equal)
    return cells.groupBy("row").agg(count.alias("n"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over the union of both patterns."""
    return coo(a.select("row", "col", "val").unionByName(b.select("row", "col", "val")))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def csr_norm(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("row", norm_of(F.col("vals"), kind).alias("v"))


def csr_row_normalize(rows: DataFrame, kind: str) -> DataFrame:
    """L1: by the sum of sizes; max: by the largest value. Rows whose divisor is 0 stay as they are."""
    by = norm_of(F.col("vals"), "L1") if kind == "L1" else F.array_max("vals")
    scaled = rows.withColumn("__s", by)
    return scaled.select("row", "cols", F.transform("vals", lambda v: F.when(F.col("__s") == 0, v).otherwise(v / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")))).alias("vals"))


def scale_by_diagonal(cells: DataFrame) -> DataFrame:
    """v / (d[row] * d[col]) with the matrix's own diagonal d; 0 where d is 0 or absent."""
    d = cells.where("row = col").select(F.col("row").alias("k"), F.col("val").alias("d"))
    out = cells.join(d.select(F.col("k").alias("row"), F.col("d").alias("dr")), "row", "left").join(d.select(F.col("k").alias("col"), F.col("d").alias("dc")), "col", "left")
    by = F.coalesce("dr", F.lit(0.0)) * F.coalesce("dc", F.lit(0.0))
    return out.select("row", "col", F.when(by == 0, 0.0).otherwise(F.col("val") / F.when(by == 0, 1.0).otherwise(by)).alias("val"))


def set_diagonal(cells: DataFrame, value: float) -> DataFrame:
    """Diagonal cells that exist get the value."""
    return cells.select("row", "col", F.when(F.col("row") == F.col("col"), F.lit(value)).otherwise(F.col("val")).alias("val"))


#: Columns whose counts are broadcast; more of them are joined by a shuffle of the cells.
FEW_COLUMNS = 1_000_000


def _with_counts(cells: DataFrame) -> DataFrame:
    """Cells with ``df``, the cells of their column. Up to ``FEW_COLUMNS`` counts, which are counted, go to all tasks and no cell moves."""
    df = spill(cells.groupBy("col").agg(F.count("*").alias("df")), "counts")
    return cells.join(F.broadcast(df) if df.count() <= FEW_COLUMNS else df, "col")


def tfidf(cells: DataFrame, n_rows: int | None = None) -> DataFrame:
    """ln(v) * ln(n_rows / df + 1), where df counts the cells of the column: a count of 1 weighs 0.

    The cells are written once and read for the counts and the weights.
    """
    cells = spill(cells.select("row", "col", "val"), "cells")
    n = _rows(cells, n_rows)
    out = _with_counts(cells).join(F.broadcast(n))
    return out.select("row", "col", (F.ln("val") * F.ln(F.col("n") / F.col("df") + 1)).alias("val"))


def bm25(cells: DataFrame, n_rows: int | None = None, k: float = 1.6, b: float = 0.75) -> DataFrame:
    """BM25 of ln(v) with row sums against their mean, idf = ln(n_rows / df + 1).

    The cells are written once, each with its row's sum, and read for the counts and the weights. A
    window gives the sums, so cells that are dealt out by row already don't move for them.
    """
    cells = spill(cells.select("row", "col", "val", F.sum("val").over(Window.partitionBy("row")).alias("len")), "cells")
    n = F.count("*") if n_rows is None else F.lit(n_rows).cast("long")
    n = cells.groupBy("row").agg(F.max("len").alias("len")).agg(n.alias("n"), F.sum("len").alias("total")).withColumn("mean", F.col("total") / F.col("n"))
    tf = F.ln("val")
    idf = F.ln(F.col("n") / F.col("df") + 1)
    out = _with_counts(cells).where("row is not null").join(F.broadcast(n))
    return out.select("row", "col", ((k + 1) * tf / (k * ((1 - b) + b * F.col("len") / F.col("mean")) + tf) * idf).alias("val"))


def _rows(cells: DataFrame, n_rows: int | None) -> DataFrame:
    if n_rows is None:
        return cells.select("row").distinct().agg(F.count("*").alias("n"))
    return cells.sparkSession.range(1).select(F.lit(n_rows).cast("long").alias("n"))


# products


def spmm(x: DataFrame, y: DataFrame, alpha: float = 1.0, z: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """alpha * X * Y + beta * Z; places without any product are absent."""
    prod = x.select("row", F.col("col").alias("k"), F.col("val").alias("a")).join(y.select(F.col("row").alias("k"), "col", F.col("val").alias("b")), "k")
    out = prod.groupBy("row", "col").agg((F.lit(alpha) * F.sum(F.col("a") * F.col("b"))).alias("val"))
    return out if z is None else add(out, z.select("row", "col", (F.lit(beta) * F.col("val")).alias("val")))


def sddmm(pattern: DataFrame, a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """alpha * (A * B) at the places of ``pattern`` plus beta times its values.

    ``a`` holds rows ``(row, vec)`` and ``b`` columns ``(col, vec)``, so each place costs one array product.
    """
    out = pattern.join(a.withColumnRenamed("vec", "__a"), "row").join(b.withColumnRenamed("vec", "__b"), "col")
    dot = F.aggregate(F.zip_with("__a", "__b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return out.select("row", "col", (F.lit(alpha) * dot + F.lit(beta) * F.col("val")).alias("val"))


def masked_matmul(mask: DataFrame, a: DataFrame, b: DataFrame, alpha: float = 1.0, shape: tuple[int, int] | None = None, width: int = 32) -> DataFrame:
    """(A * B^T) at the places of the mask; both matrices as rows.

    The mask has rows ``(row, col)``. With ``shape`` it is packed: a bitmap of that shape, or a bitset
    of its columns alone (``n_bits`` in place of rows, as ``(0, n)``), which holds for every row of A.
    """
    if shape is not None and shape[0]:
        mask = bitmap_cells(mask, *shape, width)
    elif shape is not None:
        mask = bitmap_cells(mask, 1, shape[1], width).select("col").crossJoin(a.select("row"))
    return sddmm(mask.withColumn("val", F.lit(0.0)), a, b.withColumnRenamed("row", "col"), alpha)


# symmetric forms


def symmetrize(cells: DataFrame, how: Callable[[Column, Column], Column] = lambda v, t: v + t) -> DataFrame:
    """how(value, transposed value or 0) at every place, and at the mirrored place where that has none."""
    t = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("t"))
    both = cells.join(t, ["row", "col"], "left").withColumn("out", how(F.col("val"), F.coalesce("t", F.lit(0.0))))
    mirrored = both.where("t is null and val <> 0").select(F.col("col").alias("row"), F.col("row").alias("col"), "out")
    return both.select("row", "col", "out").unionByName(mirrored).withColumnRenamed("out", "val")


def knn_symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; duplicates stay."""
    return edges.unionByName(transpose(edges))
