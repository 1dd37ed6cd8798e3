"""Random numbers and generated data, reproducible whatever the partitioning.

Every value is a hash of the row's number, a stream number and the seed, so that a task that runs
again, or a plan with other partitions, gives the same data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STEP = 2.0**-53


def uniform01(ident: Column, seed: int, stream: int | Column = 0) -> Column:
    """Uniform in (0, 1), from 53 bits of a hash."""
    s = stream if isinstance(stream, Column) else F.lit(stream)
    bits = F.shiftrightunsigned(F.xxhash64(ident, s, F.lit(seed)), 11)
    return (bits + F.lit(0.5)) * F.lit(_STEP)


def normal01(ident: Column, seed: int, stream: int | Column = 0) -> Column:
    """Standard normal by Box and Muller's formula."""
    s = stream if isinstance(stream, Column) else F.lit(stream)
    u, v = uniform01(ident, seed, s * 2 + 1), uniform01(ident, seed, s * 2 + 2)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def _two_sided(u: Column, mu: float, scale: float) -> Column:
    return F.when(u <= 0.5, F.lit(mu) + F.lit(scale) * F.ln(2 * u)).otherwise(F.lit(mu) - F.lit(scale) * F.ln(2 * (1 - u)))


def draw(kind: str, ident: Column, seed: int, *params: float, stream: int = 0) -> Column:
    """A value of the named distribution for each row."""
    u, z = uniform01(ident, seed, stream), normal01(ident, seed, stream)
    a, b = (*params, 0.0, 0.0)[:2]
    if kind == "uniform":
        return a + u * (b - a)
    if kind == "uniform_int":
        return F.floor(a + u * (b - a)).cast("long")
    if kind == "normal":
        return a + z * b
    if kind == "normal_int":
        return (a + z * b).cast("long")
    if kind == "bernoulli":
        return u < a
    if kind == "scaled_bernoulli":
        return F.when(u < a, F.lit(-b)).otherwise(F.lit(b))
    if kind == "gumbel":
        return a - b * F.ln(-F.ln(u))
    if kind == "lognormal":
        return F.exp(a + z * b)
    if kind == "logistic":
        return a - b * F.ln(1 / u - 1)
    if kind == "exponential":
        return -F.ln(1 - u) / a
    if kind == "rayleigh":
        return F.sqrt(-2 * F.ln(1 - u)) * a
    if kind == "laplace":
        return _two_sided(u, a, b)
    raise ValueError(kind)


def generate(spark: SparkSession, n: int, kind: str, seed: int, *params: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), draw(kind, F.col("id"), seed, *params).alias("v"))


def normal_table(spark: SparkSession, n_rows: int, mu: list[float], sigma: list[float], seed: int) -> DataFrame:
    """Rows of normals with a mean and a deviation for each column."""
    cols = [F.lit(m) + F.lit(s) * normal01(F.col("id"), seed, j) for j, (m, s) in enumerate(zip(mu, sigma, strict=True))]
    return spark.range(n_rows).select(F.col("id").alias("row"), F.array(*cols).alias("vec"))


def discrete(spark: SparkSession, n: int, weights: list[float], seed: int) -> DataFrame:
    """Indices drawn with probability in proportion to their weights."""
    edges = np.cumsum(weights) / np.sum(weights)
    u = uniform01(F.col("id"), seed)
    index = F.aggregate(F.array(*map(F.lit, edges[:-1].tolist())), F.lit(0).cast("long"), lambda acc, e: acc + F.when(u >= e, 1).otherwise(0))
    return spark.range(n).select(F.col("id").alias("i"), index.alias("v"))


def sample_without_replacement(items: DataFrame, k: int, seed: int, ident: str = "i", weight: str | None = None) -> DataFrame:
    """k rows, weighted if asked: the least exponential keys -ln(1-u)/w win, so a top-k is all it takes."""
    w = F.col(weight) if weight else F.lit(1.0)
    return items.withColumn("__key", -F.ln(1 - uniform01(F.col(ident), seed)) / w).orderBy("__key", ident).limit(k).drop("__key")


def excess_subsample(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """About k distinct indices of 0..n-1: more are drawn than needed, repeats dropped, k kept."""
    if k >= n:
        return spark.range(n).select(F.col("id").alias("i"))
    draws = math.ceil(math.log(1 - k / n) / math.log(1 - 1 / n) * 1.1) if n > 1 else 1
    some = spark.range(draws).select(draw("uniform_int", F.col("id"), seed, 0, n).alias("i")).distinct()
    return some.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(k)


def sample_rows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    return sample_without_replacement(rows, k, seed, "row")


def affine_params(n: int, seed: int) -> tuple[int, int]:
    """(a, b) for the permutation (a x + b) mod n, a coprime to n."""
    rng = np.random.default_rng(seed)
    a = int(rng.integers(1, max(2, n)))
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, int(rng.integers(0, max(1, n)))


def permute(cells: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Rows moved by an affine permutation, which needs no shuffle."""
    a, b = affine_params(n_rows, seed)
    return cells.withColumn("row", ((F.col("row").cast("decimal(38,0)") * a + b) % n_rows).cast("long"))


def group_sample(items: DataFrame, group: str, ident: str, weight: str, seed: int) -> DataFrame:
    """One row of each group, with probability in proportion to its weight."""
    key = -F.ln(1 - uniform01(F.col(ident), seed)) / F.col(weight)
    return items.withColumn("__key", key).groupBy(group).agg(F.min_by(ident, F.struct("__key", ident)).alias(ident))


def make_blobs(spark: SparkSession, n_rows: int, n_cols: int, n_clusters: int, seed: int, std: float | list[float] = 1.0, centres: list[list[float]] | None = None, box: tuple[float, float] = (-10.0, 10.0), shuffle: bool = True) -> DataFrame:
    """``(row, vec, label)`` of isotropic clusters; ``std`` is one deviation for all or one for each cluster."""
    c = np.array(centres) if centres is not None else np.random.default_rng(seed).uniform(*box, (n_clusters, n_cols))
    label = (F.floor(uniform01(F.col("id"), seed, 9_999) * n_clusters) if shuffle else F.col("id") % n_clusters).cast("int")
    table = F.array(*[F.array(*map(F.lit, r)) for r in c.tolist()])
    out = spark.range(n_rows).select(F.col("id").alias("row"), label.alias("label"))
    each = list(std) if isinstance(std, (list, tuple)) else [std] * len(c)
    if len(each) != len(c):
        raise ValueError("one deviation for each cluster")
    out = out.withColumns({"__c": F.element_at(table, F.col("label") + 1), "__s": F.element_at(F.array(*map(F.lit, map(float, each))), F.col("label") + 1)})
    return out.select("row", F.transform("__c", lambda x, j: x + F.col("__s") * normal01(F.col("row"), seed, j)).alias("vec"), "label")


def make_regression(
    spark: SparkSession, n_rows: int, n_cols: int, n_informative: int, seed: int, bias: float = 0.0, noise: float = 0.0, n_targets: int = 1, effective_rank: int | None = None, tail_strength: float = 0.5, shuffle: bool = False
) -> tuple[DataFrame, np.ndarray]:
    """``(row, vec, y)`` with Gaussian features, and the coefficients: n_informative features have some that are not 0.

    With several targets ``y`` is an array and the coefficients are a matrix, one column a target.
    ``effective_rank`` gives the features singular values that fall off like a bell around that rank
    with a tail of the given strength, scaled to the number of rows. ``shuffle`` moves the rows and the
    columns to other places, each by an affine permutation.
    """
    rng = np.random.default_rng(seed)
    coef = np.zeros((n_cols, n_targets))
    coef[:n_informative] = 100 * rng.uniform(size=(n_informative, n_targets))
    vec = F.array(*[normal01(F.col("id"), seed, j) for j in range(n_cols)])
    rows = spark.range(n_rows).select(F.col("id").alias("row"), vec.alias("vec"))
    if effective_rank is not None:
        from tessera.operators.linalg import project

        at = np.arange(n_cols) / effective_rank
        values = (1 - tail_strength) * np.exp(-(at**2)) + tail_strength * np.exp(-0.1 * at)
        basis, _ = np.linalg.qr(rng.standard_normal((n_cols, n_cols)))
        rows = project(rows, (np.eye(n_cols) * values) @ basis.T)  # Gaussian rows are nearly orthogonal columns of length sqrt(n)
    if shuffle:
        a, b = affine_params(n_cols, seed)
        order = [(a * j + b) % n_cols for j in range(n_cols)]
        coef = coef[order]
        rows = rows.withColumn("vec", F.array(*[F.col("vec")[j] for j in order]))
        a, b = affine_params(n_rows, seed + 1)
        rows = rows.withColumn("row", ((F.col("row").cast("decimal(38,0)") * a + b) % n_rows).cast("long"))
    dot = lambda t: F.aggregate(F.zip_with("vec", F.array(*map(F.lit, coef[:, t].tolist())), lambda x, y: x * y), F.lit(float(bias)), lambda a, x: a + x) + noise * normal01(F.col("row"), seed, n_cols + t)
    y = dot(0) if n_targets == 1 else F.array(*[dot(t) for t in range(n_targets)])
    return rows.select("row", "vec", y.alias("y")), coef[:, 0] if n_targets == 1 else coef


def multivariate_normal(spark: SparkSession, n_rows: int, mean: np.ndarray, cov: np.ndarray, seed: int, how: str = "cholesky") -> DataFrame:
    """Rows of x + L z, where L L^T is the covariance; ``how``: cholesky, jacobi or qr."""
    from tessera.operators.linalg import project

    if how == "cholesky":
        left = np.linalg.cholesky(cov)
    else:
        w, v = np.linalg.eigh(cov)
        if w.min() < -1e-9 * abs(w).max():
            raise ValueError("the covariance isn't positive semi-definite")
        left = v * np.sqrt(np.maximum(w, 0))
    z = spark.range(n_rows).select(F.col("id").alias("row"), F.array(*[normal01(F.col("id"), seed, j) for j in range(len(mean))]).alias("vec"))
    shift = F.array(*map(F.lit, np.asarray(mean, float).tolist()))
    return project(z, left.T).select("row", F.zip_with("vec", shift, lambda x, m: x + m).alias("vec"))


def rmat(spark: SparkSession, n_edges: int, r_scale: int, c_scale: int, theta: list[float] | tuple[float, float, float], seed: int = 12345) -> DataFrame:
    """``(src, dst)`` of a 2^r by 2^c recursive graph; ``theta`` is (a, b, c) or a, b, c, d for each level.

    Beyond the smaller of the scales only one side is halved, with the quadrants merged. Repeats and
    self-loops may occur.
    """
    depth = max(r_scale, c_scale)
    if len(theta) == 3:
        a, b, c = theta
        levels = [(a, b, c, 1 - a - b - c)] * depth
    else:
        levels = [tuple(theta[4 * i : 4 * i + 4]) for i in range(depth)]
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (a, b, c, d) in enumerate(levels):
        u = uniform01(F.col("id"), seed, i)
        both = i < r_scale and i < c_scale
        total = a + b + c + d
        down = (u >= (a + b) / total).cast("long")
        right = (((u >= a / total) & (u < (a + b) / total)) | (u >= (a + b + c) / total)).cast("long") if both else (u >= (a + c) / total).cast("long")
        if i < r_scale:
            src = src * 2 + down
        if i < c_scale:
            dst = dst * 2 + right
    return spark.range(n_edges).select(src.alias("src"), dst.alias("dst"))


def normal_sums(df: DataFrame) -> DataFrame:
    """Count, mean and deviation of ``v``, for checks of a distribution."""
    v = F.col("v").cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "F", "SparkSession", "Window", "annotations", "math", "np")]
