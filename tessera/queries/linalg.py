"""Dense and sparse linear algebra. Factors are unique up to signs, so queries give what the factors determine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import linalg as op
from tessera.operators.dense import to_long
from tessera.operators.graph import laplacian
from tessera.operators.sparse import coo, transpose
from tessera.plans.scratch import spill
from tessera.queries.common import E, emb_cells, emb_keys, emb_rows, order_part, table, user_edges
from tessera.registry import register


def _frame(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


@register("gemm", f'WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(sum(a.val * b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2')
def _(spark, d):
    x = emb_cells(spark, d)
    return op.gemm(transpose(x), x).withColumn("val", F.round("val", 6))


@register("gemm_trans", f'WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(2 * sum(a.val * b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2')
def _(spark, d):
    x = emb_cells(spark, d)
    return op.gemm(x, transpose(x), 2.0, trans_x=True, trans_y=True).withColumn("val", F.round("val", 6))


@register("gemm_gram", f'WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(sum(a.val * b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2')
def _(spark, d):
    return op.gram_cells(emb_rows(spark, d), centred=False).withColumn("val", F.round("val", 6))


@register("gemv", f'WITH {E} SELECT "row" AS i, round(2 * sum(val * ("col" + 1)) + 0.5 * any_value(label), 6) AS v FROM e JOIN embeddings ON vec_id = "row" GROUP BY 1')
def _(spark, d):
    x = spark.range(64).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    y = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v"))
    return op.gemv(emb_cells(spark, d), x, 2.0, y, 0.5).withColumn("v", F.round("v", 6))


@register("transpose", f'WITH {E} SELECT "col" AS "row", "row" AS "col", val FROM e')
def _(spark, d):
    return transpose(emb_cells(spark, d))


_TRACE = f'WITH {E}, m AS (SELECT "col" AS c, avg(val) AS mu, var_samp(val) AS v FROM e GROUP BY 1)'


@register("eig", f"{_TRACE} SELECT round(sum(v), 6) AS trace, true AS ascending FROM m")
def _(spark, d):
    cov = op.to_matrix(op.gram_cells(emb_rows(spark, d), True, lambda n: n - 1), 64, 64)
    w, v = op.eig(cov)
    assert np.allclose(cov @ v, v * w)
    return _frame(spark, trace=[float(w.sum())], ascending=[bool((np.diff(w) >= 0).all())]).withColumn("trace", F.round("trace", 6))


@register("svd", f'WITH {E} SELECT "row", "col", round(val, 5) AS val FROM e')
def _(spark, d):
    u, s, v = op.svd(emb_rows(spark, d))
    return to_long(op.project(u, np.diag(s) @ v.T)).withColumn("val", F.round("val", 5))


@register("rsvd", f'WITH {E} SELECT round(sum(val * val), 6) AS energy FROM e')
def _(spark, d):
    _, s, _ = op.rsvd(emb_rows(spark, d), 64)
    return _frame(spark, energy=[float((s**2).sum())]).withColumn("energy", F.round("energy", 6))


@register("qr", f'WITH {E} SELECT "row", "col", round(val, 5) AS val FROM e')
def _(spark, d):
    q, r = op.qr(emb_rows(spark, d))
    return to_long(op.project(q, r)).withColumn("val", F.round("val", 5))


@register("cholesky", f'WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(sum(a.val * b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2')
def _(spark, d):
    g = op.to_matrix(op.gram_cells(emb_rows(spark, d), False), 64, 64)
    lower = np.zeros((0, 0))
    for i in range(64):
        lower = op.cholesky_update(lower, g[i, : i + 1])
    out = lower @ lower.T
    r, c = np.divmod(np.arange(64 * 64), 64)
    return _frame(spark, row=r, col=c, val=out.ravel()).withColumn("val", F.round("val", 6))


for _name, _method in (("lstsq", "svd"), ("lstsq_qr", "qr"), ("lstsq_eig", "eig")):

    @register(_name, """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
    def _(spark, d, method=_method):
        t = table(spark, d, "lineitem").select(F.array(F.col("l_quantity"), F.lit(1.0)).alias("vec"), F.col("l_extendedprice").alias("y"))
        w = op.lstsq(t, method=method)
        return _frame(spark, slope=[float(w[0])], intercept=[float(w[1])]).select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@register("pca", f"{_TRACE} SELECT round(sum(v), 6) AS total_var, 1::DOUBLE AS total_ratio, 0::DOUBLE AS noise_var FROM m")
def _(spark, d):
    fit = op.pca(emb_rows(spark, d), 64)
    return _frame(spark, total_var=[float(fit["explained_var"].sum())], total_ratio=[float(fit["explained_var_ratio"].sum())], noise_var=[float(fit["noise_var"])]).select(F.round("total_var", 6).alias("total_var"), F.round("total_ratio", 9).alias("total_ratio"), "noise_var")


@register("pca_transform", f'WITH {E} SELECT "row" AS i, round(sum(pow(val - mu, 2)), 6) AS v FROM e JOIN (SELECT "col" AS c, avg(val) AS mu FROM e GROUP BY 1) ON c = "col" GROUP BY 1')
def _(spark, d):
    rows = emb_rows(spark, d)
    out = op.pca_transform(rows, op.pca(rows, 64))
    return out.select(F.col("row").alias("i"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("v"))


@register("tsvd", f'WITH {E} SELECT round(sum(val * val), 6) AS energy, 1::DOUBLE AS total_ratio FROM e')
def _(spark, d):
    fit = op.tsvd(emb_rows(spark, d), 64)
    return _frame(spark, energy=[float((fit["singular_vals"] ** 2).sum())], total_ratio=[float(fit["explained_var_ratio"].sum())]).select(F.round("energy", 6).alias("energy"), F.round("total_ratio", 9).alias("total_ratio"))


# each factorisation put together again, cell by cell: a wrong vector shows, as it does not in a trace


def _cells_of(spark, x):
    r, c = np.divmod(np.arange(x.size), x.shape[1])
    return _frame(spark, row=r, col=c, val=np.asarray(x, float).ravel()).withColumn("val", F.round("val", 6))


_COV = f"""WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(covar_samp(a.val, b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2"""
_GRAM = f"""WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(sum(a.val * b.val), 6) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2"""


@register("eig_covariance", _COV)
def _(spark, d):
    w, v = op.eig(op.to_matrix(op.gram_cells(emb_rows(spark, d), True, lambda n: n - 1), 64, 64))
    return _cells_of(spark, (v * w) @ v.T)


@register("pca_covariance", _COV)
def _(spark, d):
    fit = op.pca(emb_rows(spark, d), 64)
    return _cells_of(spark, (fit["components"].T * fit["explained_var"]) @ fit["components"])


@register("tsvd_gram", _GRAM)
def _(spark, d):
    fit = op.tsvd(emb_rows(spark, d), 64)
    return _cells_of(spark, (fit["components"].T * fit["singular_vals"] ** 2) @ fit["components"])


@register("rsvd_gram", _GRAM)
def _(spark, d):
    _, s, v = op.rsvd(emb_rows(spark, d), 64)
    return _cells_of(spark, (v * s**2) @ v.T)


def _path(spark, n):
    """Laplacian of a path, whose eigenvalues are 2 - 2 cos(pi k / n)."""
    e = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    off = e.select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(-1.0).alias("val")).unionByName(e.select(F.col("b").alias("row"), F.col("a").alias("col"), F.lit(-1.0).alias("val")))
    diag = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.when((F.col("id") == 0) | (F.col("id") == n - 1), 1.0).otherwise(2.0).alias("val"))
    return off.unionByName(diag)


@register("lanczos", "SELECT round(2 - 2 * cos(pi() * k.range / 60), 6) AS v FROM range(56, 60) k")
def _(spark, d):
    w, _ = op.eigsh(_path(spark, 60), 60, 4, "LA", local_cells=1000)
    return _frame(spark, v=w).withColumn("v", F.round("v", 6))


@register("eigsh", "SELECT round(2 - 2 * cos(pi() * k.range / 40), 6) AS v FROM range(37, 40) k")
def _(spark, d):
    w, _ = op.eigsh(_path(spark, 40), 40, 3, "LM", local_cells=1000)
    return _frame(spark, v=w).withColumn("v", F.round("v", 6))


@register("randomized_svds", "SELECT round(2 - 2 * cos(pi() * k.range / 30), 4) AS v FROM range(27, 30) k")
def _(spark, d):
    s = op.svds(_path(spark, 30), 30, 30, 3, n_oversamples=20, n_power_iters=8, return_singular_vectors=False, local_cells=1000)
    return _frame(spark, v=s).withColumn("v", F.round("v", 4))


# the solvers over whole tables, with products in the cluster at every scale; SQL can't express them


def _size(cells, name):
    """Rows or columns up to the largest number."""
    last = cells.agg(F.max(name)).first()[0]
    return 0 if last is None else last + 1


def _customers(spark, d):
    """Laplacian of the customers' graph, and its size."""
    e = user_edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    cells = spill(laplacian(coo(both.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val")))), "laplacian")
    return cells, _size(cells, "row")


@register("lanczos_customers")
def _(spark, d):
    cells, n = _customers(spark, d)
    w, _ = op.eigsh_frame(cells, n, 4, "LA")
    return _frame(spark, v=w)


@register("eigsh_customers")
def _(spark, d):
    cells, n = _customers(spark, d)
    w, v = op.eigsh_frame(cells, n, 3, "LM")
    values = F.broadcast(_frame(spark, k=np.arange(3), value=w))
    return v.join(values, "k").select("k", "i", "value", "x")


@register("randomized_svds_orders")
def _(spark, d):
    cells = spill(order_part(spark, d), "orders")
    s = op.svds(cells, _size(cells, "row"), _size(cells, "col"), 3, n_oversamples=20, n_power_iters=16, return_singular_vectors=False, local_cells=0)
    return _frame(spark, v=s)
