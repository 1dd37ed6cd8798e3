"""Dense matrices: maps, reductions, broadcasts and data movement.

Two forms are used. *Long*: ``(row, col, val)``, one cell a row; what a plan does with keys (joins,
grouped sums, re-indexing) is stated on it. *Rows*: ``(row, vec)``, one array a row; what stays
inside a row (norms, sorts, shifts) runs on it without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.elementwise import divide

Fn = Callable[..., Column]


# forms


def to_long(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.posexplode("vec").alias("col", "val")).select("row", F.col("col").cast("long").alias("col"), "val")


def to_rows(cells: DataFrame) -> DataFrame:
    """Arrays in column order; a cell that is absent is absent, so give every cell."""
    packed = F.sort_array(F.collect_list(F.struct("col", "val")))
    return cells.groupBy("row").agg(F.transform(packed, lambda x: x["val"]).alias("vec"))


# maps


def map_cells(cells: DataFrame, f: Fn, *others: DataFrame) -> DataFrame:
    """val = f(val, other vals...) over matrices of the same cells."""
    out, args = cells.withColumnRenamed("val", "v0"), ["v0"]
    for i, other in enumerate(others, 1):
        out = out.join(other.withColumnRenamed("val", f"v{i}"), ["row", "col"])
        args.append(f"v{i}")
    return out.select("row", "col", f(*map(F.col, args)).alias("val"))


def map_offset(rows: DataFrame, f: Fn) -> DataFrame:
    """vec[i] = f(i, vec[i]) inside each row."""
    return rows.select("row", F.transform("vec", lambda x, i: f(i, x)).alias("vec"))


def axpy(x: DataFrame, y: DataFrame, alpha: float) -> DataFrame:
    """alpha * x + y for vectors ``(i, v)``."""
    return x.withColumnRenamed("v", "__x").join(y, "i").select("i", (F.lit(float(alpha)) * F.col("__x") + F.col("v")).alias("v"))


def ratio(cells: DataFrame) -> DataFrame:
    """Each cell by the sum of all; the sum is one row."""
    total = cells.agg(F.sum("val").alias("__total"))
    return cells.join(F.broadcast(total)).select("row", "col", divide(F.col("val"), F.col("__total")).alias("val"))


def fill(spark: SparkSession, n_rows: int, n_cols: int, value: float) -> DataFrame:
    return spark.range(n_rows).select(F.col("id").alias("row"), F.array_repeat(F.lit(float(value)), n_cols).alias("vec"))


def value_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end).select((F.col("id") - start).alias("i"), F.col("id").alias("v"))


# reductions


def reduce_cells(cells: DataFrame, along: str, main: Fn = lambda x: x, how: Callable[[Column], Column] = F.sum, final: Fn = lambda x: x, old: DataFrame | None = None, merge: Fn = lambda old, new: old + new) -> DataFrame:
    """final(how(main(val))) per row or per column; partial aggregates run before the shuffle.

    With ``old`` values ``(i, v)`` the result is final(merge(old, how(main(val)))); one that only
    either side has stays as it is.
    """
    out = cells.groupBy(F.col(along).alias("i")).agg(how(main(F.col("val"))).alias("v"))
    if old is not None:
        out = out.join(old.select("i", F.col("v").alias("__old")), "i", "full")
        out = out.select("i", F.when(F.col("__old").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("__old")).otherwise(merge(F.col("__old"), F.col("v"))).alias("v"))
    return out.select("i", final(F.col("v")).alias("v"))


def reduce_rows(rows: DataFrame, init: float, main: Fn, merge: Fn, final: Fn = lambda x: x) -> DataFrame:
    """A fold inside each row, without a shuffle."""
    return rows.select(F.col("row").alias("i"), final(F.aggregate("vec", F.lit(init), lambda acc, x: merge(acc, main(x)))).alias("v"))


def compensated_sum(vec: Column) -> Column:
    """Sum of an array with Neumaier's correction."""

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(vec, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda acc: acc["s"] + acc["c"])


def map_reduce(df: DataFrame, f: Column, how: Callable[[Column], Column], neutral: float) -> DataFrame:
    """One value; an empty input gives the neutral element."""
    return df.agg(F.coalesce(how(f), F.lit(neutral)).alias("v"))


def reduce_rows_by_key(cells: DataFrame, keys: DataFrame, weights: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """(key, col, sum of weight * val) for ``keys`` ``(row, key)`` and ``weights`` ``(row, w)``.

    Keys without rows are absent; see :func:`dense_grid` to fill them with 0. The sums are added to
    ``old`` ones ``(key, col, val)``, if given.
    """
    w = F.lit(1.0)
    joined = cells.join(keys, "row")
    if weights is not None:
        joined, w = joined.join(weights, "row"), F.col("w")
    out = joined.groupBy("key", "col").agg(F.sum(w * F.col("val")).alias("val"))
    return out if old is None else out.unionByName(old.select("key", "col", "val")).groupBy("key", "col").agg(F.sum("val").alias("val"))


def reduce_cols_by_key(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, key, sum of val) for ``keys`` ``(col, key)``."""
    return cells.join(keys, "col").groupBy("row", "key").agg(F.sum("val").alias("val"))


def dense_grid(cells: DataFrame, spark: SparkSession, first: str, n_first: int, second: str, n_second: int) -> DataFrame:
    """Every cell of an n_first by n_second grid, 0 where ``cells`` has none."""
    grid = spark.range(n_first).select(F.col("id").alias(first), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_second - 1).cast("long"))).alias(second))
    return grid.join(cells, [first, second], "left").select(first, second, F.coalesce("val", F.lit(0.0)).alias("val"))


def norm_of(vec: Column, kind: str, root: bool = False) -> Column:
    """L0, L1, L2 (without the root unless asked for) or Linf of an array."""
    zero = F.lit(0.0)
    if kind == "L1":
        out = F.aggregate(vec, zero, lambda a, x: a + F.abs(x))
    elif kind == "L2":
        out = F.aggregate(vec, zero, lambda a, x: a + x * x)
    elif kind == "Linf":
        out = F.aggregate(vec, zero, lambda a, x: F.greatest(a, F.abs(x)))
    elif kind == "L0":
        out = F.aggregate(vec, zero, lambda a, x: a + F.when(x != 0, 1.0).otherwise(0.0))
    else:
        raise ValueError(kind)
    return F.sqrt(out) if root else out


def norm(rows: DataFrame, kind: str, root: bool = False) -> DataFrame:
    return rows.select(F.col("row").alias("i"), norm_of(F.col("vec"), kind, root).alias("v"))


def normalize(rows: DataFrame, kind: str = "L2", eps: float = 1e-8) -> DataFrame:
    """Rows divided by their norm (L2 with its root); rows with a norm of at most eps become null."""
    n = norm_of(F.col("vec"), kind, kind == "L2")
    scaled = rows.withColumn("__n", n)
    return scaled.select("row", F.when(F.col("__n") > eps, F.transform("vec", lambda x: x / F.col("__n"))).alias("vec"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.withColumnRenamed("v", "__x").join(y, "i").agg(F.sum(F.col("__x") * F.col("v")).alias("v"))


def mean_squared_error(a: DataFrame, b: DataFrame, weight: float = 1.0) -> DataFrame:
    d = F.col("__a") - F.col("v")
    return a.withColumnRenamed("v", "__a").join(b, "i").agg((F.sum(F.lit(float(weight)) * d * d) / F.count("*")).alias("v"))


def arg_best(rows: DataFrame, largest: bool) -> DataFrame:
    """Index of the largest or smallest value of each row, the lowest among equals; NaN is never chosen."""
    best = F.array_max if largest else F.array_min
    clean = F.filter("vec", lambda x: ~F.isnan(x))
    at = F.array_position(F.col("vec"), best(clean)) - 1
    return rows.select(F.col("row").alias("i"), F.when(F.size(clean) == 0, F.lit(0)).otherwise(at).cast("long").alias("v"))


# broadcasts


def matrix_vector(cells: DataFrame, vec: DataFrame, f: Fn, along: str = "col", *more: DataFrame) -> DataFrame:
    """val = f(val, vec[along], ...) with vectors ``(i, v)`` matched on the row or the column."""
    out, args = cells, [F.col("val")]
    for n, v in enumerate((vec, *more)):
        out = out.join(v.select(F.col("i").alias(along), F.col("v").alias(f"__v{n}")), along)
        args.append(F.col(f"__v{n}"))
    return out.select("row", "col", f(*args).alias("val"))


def mult_skip_zero(x: Column, y: Column) -> Column:
    return F.when(y == 0, x).otherwise(x * y)


def div_skip_zero(x: Column, y: Column, return_zero: bool = False, eps: float = 1e-10) -> Column:
    small = F.abs(y) < eps
    return F.when(small, F.lit(0.0) if return_zero else x).otherwise(x / F.when(small, F.lit(1.0)).otherwise(y))


# movement


def gather(cells: DataFrame, index: DataFrame, transform: Fn = lambda x: x) -> DataFrame:
    """out[i, :] = in[transform(map[i]), :] for ``index`` ``(i, src)``."""
    return index.select("i", transform(F.col("src")).alias("row")).join(cells, "row").select(F.col("i").alias("row"), "col", "val")


def gather_if(cells: DataFrame, index: DataFrame, predicate: Fn) -> DataFrame:
    """As :func:`gather`, of the rows whose ``stencil`` passes; the others are absent."""
    return gather(cells, index.where(predicate(F.col("stencil"))))


def scatter(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Row i moves to map[i]; ``index`` ``(i, dst)`` is a permutation."""
    return cells.join(index.withColumnRenamed("i", "row"), "row").select(F.col("dst").alias("row"), "col", "val")


def slice_cells(cells: DataFrame, row1: int, row2: int, col1: int, col2: int) -> DataFrame:
    """Half-open rectangle, with indices from 0 again."""
    if not (0 <= row1 < row2 and 0 <= col1 < col2):
        raise ValueError("a slice needs 0 <= begin < end")
    inside = (F.col("row") >= row1) & (F.col("row") < row2) & (F.col("col") >= col1) & (F.col("col") < col2)
    return cells.where(inside).select((F.col("row") - row1).alias("row"), (F.col("col") - col1).alias("col"), "val")


def reverse_cols(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.reverse("vec").alias("vec"))


def reverse_rows(cells: DataFrame, n_rows: int) -> DataFrame:
    return cells.select((F.lit(n_rows - 1) - F.col("row")).alias("row"), "col", "val")


def top_left(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """The first rows and columns, with their indices."""
    return cells.where((F.col("row") < n_rows) & (F.col("col") < n_cols))


def shift_cols(rows: DataFrame, k: int, value: float | DataFrame | None = None, to_end: bool = True) -> DataFrame:
    """Columns move by k; vacated cells get ``value``, or the row's number where it is None.

    A DataFrame ``(row, vec)`` of k values a row fills the vacated cells in their order.
    """
    if isinstance(value, DataFrame):
        rows, pad = rows.join(value.select("row", F.col("vec").alias("__fill")), "row"), F.col("__fill")
    else:
        pad = F.array_repeat(F.lit(value) if value is not None else F.col("row").cast("double"), k)
    n = F.size("vec")
    kept = F.slice("vec", F.lit(1), n - k) if to_end else F.slice("vec", F.lit(k + 1), n - k)
    return rows.select("row", (F.concat(pad, kept) if to_end else F.concat(kept, pad)).alias("vec"))


def shift_rows(rows: DataFrame, n_rows: int, k: int, value: float | DataFrame | None = None, to_end: bool = True) -> DataFrame:
    """Rows move by k; vacated rows are filled with ``value``, or with their own number where it is None.

    A DataFrame ``(row, vec)`` of k rows fills them in its order.
    """
    target = F.col("row") + (k if to_end else -k)
    moved = rows.select(target.alias("row"), "vec").where((F.col("row") >= 0) & (F.col("row") < n_rows))
    vacated = (F.col("row") < k) if to_end else (F.col("row") >= n_rows - k)
    if isinstance(value, DataFrame):
        return moved.unionByName(value.where(F.col("row") < k).select((F.col("row") + (0 if to_end else n_rows - k)).alias("row"), "vec"))
    empty = F.col("row").cast("double") if value is None else F.lit(value)
    return moved.unionByName(rows.where(vacated).select("row", F.transform("vec", lambda _: empty).alias("vec")))


def upper_triangle(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    k = min(n_rows, n_cols)
    return cells.where((F.col("col") >= F.col("row")) & (F.col("row") < k) & (F.col("col") < k))


def diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("row = col").select(F.col("row").alias("i"), F.col("val").alias("v"))


def set_diagonal(cells: DataFrame, vec: DataFrame) -> DataFrame:
    v = vec.select(F.col("i").alias("row"), "v")
    return cells.join(v, "row", "left").select("row", "col", F.when((F.col("row") == F.col("col")) & F.col("v").isNotNull(), F.col("v")).otherwise(F.col("val")).alias("val"))


def invert_diagonal(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", F.when(F.col("row") == F.col("col"), divide(F.lit(1.0), F.col("val"))).otherwise(F.col("val")).alias("val"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    """Identity as sparse cells."""
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def sign_flip(cells: DataFrame) -> DataFrame:
    """Columns whose entry of largest size is negative change sign; the lowest row decides among equals."""
    lead = cells.groupBy("col").agg(F.max_by("val", F.struct(F.abs("val"), -F.col("row"))).alias("__lead"))
    return cells.join(lead, "col").select("row", "col", F.when(F.col("__lead") < 0, -F.col("val")).otherwise(F.col("val")).alias("val"))


def print_rows(rows: DataFrame, separator: str = " ") -> DataFrame:
    return rows.select("row", F.array_join(F.transform("vec", lambda x: F.format_string("%1.4f", x)), separator).alias("line"))


def sort_rows(rows: DataFrame) -> DataFrame:
    """Per row the ascending order of its values: ``order`` (indices) and ``vec`` (sorted); NaN is largest."""
    pairs = F.array_sort(F.transform("vec", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    packed = rows.withColumn("__p", pairs)
    return packed.select("row", F.transform("__p", lambda p: p["i"].cast("long")).alias("order"), F.transform("__p", lambda p: p["v"]).alias("vec"))


def select_k(rows: DataFrame, k: int, smallest: bool = True, payload: str | None = None) -> DataFrame:
    """Per row the k smallest or largest values with their indices, best first.

    NaN counts as largest; the lower index comes first among equals. Works inside each row: no
    shuffle, and no more than one row in memory. ``payload`` names an array column as long as
    ``vec``; its entries take the place of the indices.
    """
    pairs = F.transform("vec", lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    if smallest:
        best = F.array_sort(pairs)
    else:
        best = F.array_sort(pairs, lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    packed = rows.withColumn("__p", F.slice(best, 1, k))
    found = (lambda i: i.cast("long")) if payload is None else (lambda i: F.element_at(F.col(payload), i + 1))
    return packed.select("row", F.transform("__p", lambda p: p["v"]).alias("vals"), F.transform("__p", lambda p: found(p["i"])).alias("idx"))


def select_k_cells(cells: DataFrame, k: int, smallest: bool = True) -> DataFrame:
    """The same on cells, sparse ones too; the window's group limit prunes before the shuffle."""
    order = Window.partitionBy("row").orderBy(F.col("val").asc() if smallest else F.col("val").desc(), F.col("col"))
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
