"""Random numbers and generated data: the values are reproducible, and their moments are compared with the theory."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import collectives as comms
from tessera.operators import rand as op
from tessera.operators.linalg import lstsq
from tessera.queries.common import emb_cells, emb_rows, table
from tessera.registry import register

_N = 40_000
_EULER = 0.5772156649015329


def _moments(name, kind, params, mean, std):
    """Whether mean and deviation lie within five standard errors of the theory."""

    def run(spark, d):
        s = op.normal_sums(op.generate(spark, _N, kind, 7, *params).withColumn("v", F.col("v").cast("double")) if kind != "bernoulli" else op.generate(spark, _N, kind, 7, *params).withColumn("v", F.col("v").cast("int")))
        return s.select("n", (F.abs(F.col("mean") - mean) <= 5 * std / math.sqrt(_N)).alias("mean_ok"), (F.abs(F.col("std") - std) <= 0.05 * std).alias("std_ok"))

    register(name, f"SELECT {_N}::BIGINT AS n, true AS mean_ok, true AS std_ok")(run)


_moments("rng_uniform", "uniform", (-1.0, 3.0), 1.0, 4 / math.sqrt(12))
_moments("rng_uniformInt", "uniform_int", (0.0, 10.0), 4.5, math.sqrt(99 / 12))
_moments("rng_normal", "normal", (5.0, 2.0), 5.0, 2.0)
_moments("rng_normalInt", "normal_int", (1000.0, 50.0), 999.5, 50.0)
_moments("rng_bernoulli", "bernoulli", (0.3,), 0.3, math.sqrt(0.21))
_moments("rng_scaled_bernoulli", "scaled_bernoulli", (0.25, 2.0), 1.0, math.sqrt(3.0))
_moments("rng_gumbel", "gumbel", (1.0, 2.0), 1 + 2 * _EULER, 2 * math.pi / math.sqrt(6))
_moments("rng_lognormal", "lognormal", (0.0, 0.5), math.exp(0.125), math.sqrt((math.exp(0.25) - 1) * math.exp(0.25)))
_moments("rng_logistic", "logistic", (2.0, 1.5), 2.0, 1.5 * math.pi / math.sqrt(3))
_moments("rng_exponential", "exponential", (0.5,), 2.0, 2.0)
_moments("rng_rayleigh", "rayleigh", (2.0,), 2 * math.sqrt(math.pi / 2), 2 * math.sqrt(2 - math.pi / 2))
_moments("rng_laplace", "laplace", (1.0, 2.0), 1.0, 2 * math.sqrt(2))


@register("rng_normalTable", "SELECT range AS i, true AS ok FROM range(3)")
def _(spark, d):
    t = op.normal_table(spark, _N, [0.0, 5.0, -3.0], [1.0, 2.0, 0.5], 3).select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    want = F.element_at(F.array(F.lit(0.0), F.lit(5.0), F.lit(-3.0)), F.col("i") + 1)
    return t.select(F.col("i").cast("long").alias("i"), (F.abs(F.col("m") - want) < 0.06).alias("ok"))


@register("rng_discrete", "SELECT range AS v, true AS ok FROM range(4)")
def _(spark, d):
    counts = op.discrete(spark, _N, [1.0, 2.0, 3.0, 4.0], 5).groupBy("v").agg(F.count("*").alias("n"))
    return counts.select("v", (F.abs(F.col("n") / _N - (F.col("v") + 1) / 10) < 0.015).alias("ok"))


@register("sample_wo_replacement", "SELECT 500::BIGINT AS n, 500::BIGINT AS distinct_n")
def _(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("w"))
    return op.sample_without_replacement(items, 500, 3, weight="w").agg(F.count("*").alias("n"), F.count_distinct("i").alias("distinct_n"))


@register("excess_subsample", "SELECT 1000::BIGINT AS n, 1000::BIGINT AS distinct_n, true AS inside")
def _(spark, d):
    return op.excess_subsample(spark, 100_000, 1000, 9).agg(F.count("*").alias("n"), F.count_distinct("i").alias("distinct_n"), F.bool_and(F.col("i").between(0, 99_999)).alias("inside"))


@register("sample_rows", "SELECT 50::BIGINT AS n, 50::BIGINT AS distinct_n")
def _(spark, d):
    return op.sample_rows(emb_rows(spark, d), 50, 4).agg(F.count("*").alias("n"), F.count_distinct("row").alias("distinct_n"))


@register("affine_params", "SELECT 1000::BIGINT AS n, 1000::BIGINT AS distinct_n")
def _(spark, d):
    a, b = op.affine_params(1000, 8)
    return spark.range(1000).select(((F.col("id") * a + b) % 1000).alias("x")).agg(F.count("*").alias("n"), F.count_distinct("x").alias("distinct_n"))


@register("permute", 'SELECT sum(vec_id)::BIGINT AS rows, count(*) * 64 AS cells FROM embeddings')
def _(spark, d):
    cells = emb_cells(spark, d)
    n = table(spark, d, "embeddings").count()
    out = op.permute(cells, n, 6)
    return out.agg(F.sum_distinct("row").alias("rows"), F.count("*").alias("cells"))


@register("device_sample", "SELECT c_nationkey::BIGINT AS g, true AS inside FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("g"), F.col("c_custkey").alias("i"), (F.abs("c_acctbal") + 1).alias("w"))
    picked = op.group_sample(c, "g", "i", "w", 2)
    return picked.join(c.select("g", "i", F.lit(True).alias("inside")), ["g", "i"], "left").select("g", F.coalesce("inside", F.lit(False)).alias("inside"))


@register("make_blobs", "SELECT range::INT AS label, true AS ok FROM range(3)")
def _(spark, d):
    centres = [[0.0, 10.0], [5.0, -5.0], [-8.0, 1.0]]
    t = op.make_blobs(spark, _N, 2, 3, 4, 1.0, centres).groupBy("label").agg(F.avg(F.col("vec")[0]).alias("x"), F.avg(F.col("vec")[1]).alias("y"))
    want = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("label") + 1)
    return t.select("label", ((F.abs(F.col("x") - want[0]) < 0.06) & (F.abs(F.col("y") - want[1]) < 0.06)).alias("ok"))


@register("make_blobs_std", "SELECT range::INT AS label, true AS ok FROM range(3)")
def _(spark, d):
    t = op.make_blobs(spark, _N, 2, 3, 4, [0.5, 1.0, 3.0], [[0.0, 10.0], [5.0, -5.0], [-8.0, 1.0]]).groupBy("label").agg(F.stddev_samp(F.col("vec")[0]).alias("x"), F.stddev_samp(F.col("vec")[1]).alias("y"))
    want = F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(3.0)), F.col("label") + 1)
    return t.select("label", ((F.abs(F.col("x") / want - 1) < 0.03) & (F.abs(F.col("y") / want - 1) < 0.03)).alias("ok"))


@register("make_regression_targets", "SELECT t.range AS t, i.range AS i, true AS ok FROM range(2) t, range(5) i")
def _(spark, d):
    x, coef = op.make_regression(spark, 20_000, 5, 3, 4, noise=0.5, n_targets=2, shuffle=True)
    w = np.array([lstsq(x.select("vec", F.col("y")[t].alias("y"))) for t in range(2)])
    return spark.createDataFrame(pa.table({"t": np.repeat(np.arange(2), 5), "i": np.tile(np.arange(5), 2), "ok": (np.abs(w - coef.T) < 0.05).ravel()}))


@register("make_regression_rank", "SELECT true AS falls, true AS small_tail")
def _(spark, d):
    from tessera.operators.linalg import svd

    x, _ = op.make_regression(spark, 5_000, 20, 20, 4, effective_rank=3, tail_strength=0.01)
    _, s, _ = svd(x.select("row", "vec"))
    return spark.createDataFrame(pa.table({"falls": [bool((np.diff(s) <= 0).all())], "small_tail": [bool(s[12] < 0.05 * s[0])]}))


@register("make_regression", "SELECT range AS i, true AS ok FROM range(5)")
def _(spark, d):
    t, coef = op.make_regression(spark, 20_000, 5, 3, 4, bias=0.0, noise=0.5)
    w = lstsq(t)
    return spark.createDataFrame(pa.table({"i": np.arange(5), "ok": np.abs(w - coef) < 0.05}))


@register("mvg", "SELECT range AS i, true AS ok FROM range(3)")
def _(spark, d):
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    ok = []
    for how in ("cholesky", "jacobi", "qr"):
        t = op.multivariate_normal(spark, _N, np.array([1.0, -2.0]), cov, 3, how).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
        r = t.agg(F.avg("x"), F.avg("y"), F.covar_samp("x", "y"), F.var_samp("x"), F.var_samp("y")).first()
        ok.append(bool(np.abs(np.array(r) - [1, -2, 0.5, 2, 1]).max() < 0.06))
    return spark.createDataFrame(pa.table({"i": np.arange(3), "ok": ok}))


@register("rmat", "SELECT 20000::BIGINT AS n, true AS inside, true AS skewed")
def _(spark, d):
    e = op.rmat(spark, 20_000, 10, 8, (0.57, 0.19, 0.19))
    return e.agg(F.count("*").alias("n"), F.bool_and((F.col("src") < 1024) & (F.col("dst") < 256)).alias("inside"), (F.avg((F.col("src") < 512).cast("int")) > 0.7).alias("skewed"))


# packed bits, key-value pairs and integer helpers


@register("bitset", """WITH b AS (SELECT p_partkey AS i, p_size > 25 AS bit FROM part) SELECT count(*) AS size, count(*) FILTER (WHERE bit) AS n_set, count(*) FILTER (WHERE NOT bit) AS n_flipped, bool_or(bit) AS any_set, bool_and(bit) AS all_set FROM b""")
def _(spark, d):
    from tessera.operators import bits

    s = bits.bitset(table(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") > 25).alias("bit")))
    return bits.summary(s)


@register("bitmap", "SELECT n_regionkey::BIGINT AS \"row\", n_nationkey::BIGINT AS \"col\", n_nationkey % 2 = 0 AS bit FROM nation")
def _(spark, d):
    from tessera.operators import bits

    n = table(spark, d, "nation")
    some = n.where("n_nationkey % 2 = 0").select((F.col("n_regionkey") * 25 + F.col("n_nationkey")).cast("long").alias("i"))
    at = n.select(F.col("n_regionkey").cast("long").alias("row"), F.col("n_nationkey").cast("long").alias("col"))
    return bits.test(bits.from_indices(some), at.withColumn("i", F.col("row") * 25 + F.col("col"))).select("row", "col", "bit")


@register("bitset_packed", """WITH b AS (SELECT p_partkey AS i, p_size > 25 AS bit FROM part), n AS (SELECT max(p_partkey) + 1 AS n FROM part), z AS (SELECT range AS i FROM range((SELECT n + 10 FROM n)))
SELECT z.i, z.i >= n OR (coalesce(bit, false) AND z.i <> 7) AS bit FROM z LEFT JOIN b ON b.i = z.i, n""")
def _(spark, d):
    from tessera.operators import bits

    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("i"), (F.col("p_size") > 25).alias("bit"))
    n = p.agg(F.max("i")).first()[0] + 1
    flags = bits.to_flags(bits.from_indices(p.where("bit").select("i")), n)
    flags = bits.set_bits(flags, spark.range(7, 8).select(F.col("id").alias("i")), False)
    return bits.resize(flags, n + 10, True)


@register("bitset_flip_repeat", """WITH z AS (SELECT n_nationkey::BIGINT AS i, n_nationkey % 3 <> 0 AS bit FROM nation) SELECT i + t.range * 25 AS i, bit FROM z, range(3) t""")
def _(spark, d):
    from tessera.operators import bits

    flags = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (F.col("n_nationkey") % 3 == 0).alias("bit"))
    return bits.repeat(bits.flip(flags), 3, 25)


@register("popc", "SELECT sum(bit_count(p_partkey::BIGINT))::BIGINT AS n FROM part")
def _(spark, d):
    from tessera.operators import bits

    return bits.popcount(table(spark, d, "part").select((F.col("p_partkey") - 1).alias("at"), F.col("p_partkey").alias("word")))


@register("popc_max_len", "SELECT sum(bit_count(CASE WHEN p_partkey <= 20 THEN p_partkey WHEN p_partkey = 21 THEN p_partkey & 15 ELSE 0 END::BIGINT))::BIGINT AS n FROM part")
def _(spark, d):
    from tessera.operators import bits

    words = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("at"), F.col("p_partkey").alias("word"))
    return bits.popcount(words, 20 * 32 + 4)


@register("kvp", "SELECT c_nationkey AS g, arg_min(c_custkey, (c_acctbal, c_custkey)) AS key, min(c_acctbal) AS value FROM customer GROUP BY 1")
def _(spark, d):
    pair = F.struct(F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("key"))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.min(pair).alias("p")).select("g", "p.key", "p.value")


@register("util_integer", "SELECT p_partkey AS i, (p_partkey // 7)::BIGINT AS quotient, ((p_partkey + 31) // 32 * 32)::BIGINT AS up, (p_partkey // 32 * 32)::BIGINT AS down FROM part")
def _(spark, d):
    i = F.col("p_partkey")
    return table(spark, d, "part").select(i.alias("i"), F.floor(i / 7).alias("quotient"), (F.ceil(i / 32) * 32).alias("up"), (F.floor(i / 32) * 32).alias("down"))


@register("serialize_npy", 'SELECT vec_id AS "row", list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings')
def _(spark, d):
    from tessera.plans.scratch import new_path
    from tessera.sources import npy

    path = new_path(spark, "npy")
    npy.write_rows(emb_rows(spark, d), path)
    return npy.read_rows(spark, path)


@register("npy_scalar", "SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem")
def _(spark, d):
    from tessera.sources import npy

    r = table(spark, d, "lineitem").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n")).first()
    total, n = (npy.scalar_from_bytes(npy.scalar_to_bytes(x)) for x in (float(r.total), int(r.n)))
    return spark.createDataFrame([(total, n)], "total double, n long")


@register("npy_header", "SELECT count(*) AS n_rows, 64::BIGINT AS n_cols, false AS fortran, '<f8' AS kind FROM embeddings")
def _(spark, d):
    from tessera.sources import npy

    shape, fortran, kind = npy.read_header(npy.write_header((table(spark, d, "embeddings").count(), 64), "<f8"))
    return spark.createDataFrame([(*shape, fortran, kind.str)], "n_rows long, n_cols long, fortran boolean, kind string")


@register("copy_cast", 'SELECT vec_id AS "row", list_transform(embedding, lambda x: trunc(x * 100)::BIGINT) AS vec FROM embeddings')
def _(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: (x * F.lit(100).cast("float")).cast("long")).alias("vec"))


# collectives: a rank for each nation, which holds the balances of its customers

_HELD = "h AS (SELECT c_nationkey::BIGINT AS rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_acctbal AS v FROM customer), k AS (SELECT DISTINCT rank FROM h)"
_ALL = "g AS (SELECT row_number() OVER (ORDER BY rank, i) - 1 AS i, v FROM h)"


def _held(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("rank"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return c.select("rank", (F.row_number().over(Window.partitionBy("rank").orderBy("key")) - 1).cast("long").alias("i"), "v")


for _name, _sql, _call in (
    ("comms_reduce", "SELECT 0::BIGINT AS rank, i, max(v) AS v FROM h GROUP BY 2", lambda h: comms.reduce(h, "max")),
    ("comms_allreduce_each", "SELECT rank, i, v FROM k, (SELECT i, min(v) AS v FROM h GROUP BY 1)", lambda h: comms.allreduce(h, "min")),
    ("comms_bcast", "SELECT k.rank, i, v FROM k, h WHERE h.rank = 3", lambda h: comms.bcast(h, 3)),
    ("comms_gather", f"{_ALL} SELECT 0::BIGINT AS rank, i, v FROM g", lambda h: comms.gather(h)),
    ("comms_allgather", f"{_ALL} SELECT rank, i, v FROM k, g", lambda h: comms.allgather(h)),
    ("comms_reducescatter", "SELECT i // 4 AS rank, i % 4 AS i, max(v) AS v FROM h GROUP BY ALL", lambda h: comms.reducescatter(h, 4, "max")),
):

    @register(_name, f"WITH {_HELD}{', ' if _sql.startswith('g AS') else ' '}{_sql}")
    def _(spark, d, call=_call):
        return call(_held(spark, d))


@register("comms_barrier", "SELECT count(DISTINCT c_nationkey) AS n FROM customer")
def _(spark, d):
    return spark.createDataFrame([(comms.barrier(_held(spark, d)),)], "n long")


@register("comms_allreduce", "SELECT sum(l_quantity) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.sum("l_quantity").alias("total"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@register("streaming_meanvar", "SELECT l_returnflag AS key, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _(spark, d):
    from tessera.streaming.moments import run_available

    out = run_available(spark, f"{d}/lineitem.parquet", "l_returnflag", "l_quantity")
    return out.select("key", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))
