"""Labels and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import labels as op
from tessera.queries.common import table
from tessera.registry import register


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") * 3).cast("long").alias("label"))


@register("unique_labels", "SELECT DISTINCT (p_size * 3)::BIGINT AS label FROM part")
def _(spark, d):
    return op.unique_labels(_sizes(spark, d))


@register("ovr_labels", "SELECT p_partkey AS i, CASE WHEN p_size = 7 THEN 1 ELSE -1 END AS label FROM part")
def _(spark, d):
    return op.one_vs_rest(_sizes(spark, d), 21)


@register("make_monotonic", "SELECT p_partkey AS i, dense_rank() OVER (ORDER BY p_size) AS label FROM part")
def _(spark, d):
    return op.make_monotonic(_sizes(spark, d))


@register("merge_labels", """WITH RECURSIVE t AS (SELECT c_custkey AS i, (c_nationkey + 1)::BIGINT AS a, (c_custkey % 40 + 1)::BIGINT AS b, c_custkey % 11 = 0 AS m FROM customer),
e AS (SELECT DISTINCT a AS x, b AS y FROM t WHERE m UNION SELECT DISTINCT b, a FROM t WHERE m),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY 1)
SELECT i, coalesce(c, a) AS label FROM t LEFT JOIN c ON x = a""")
def _(spark, d):
    c = table(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("i"), (F.col("c_nationkey") + 1).cast("long").alias("a"), (F.col("c_custkey") % 40 + 1).cast("long").alias("b"), (F.col("c_custkey") % 11 == 0).alias("mask"))
    return op.merge_labels(t)


@register("linear_assignment", """WITH c AS (SELECT b.range AS b, r.range AS r, k.range AS k, ((b.range * 31 + r.range * 17 + k.range * k.range * 7 + r.range * k.range * 13) % 29)::DOUBLE AS cost FROM range(6) b, range(4) r, range(4) k),
p AS (SELECT x.b, x.cost + y.cost + z.cost + w.cost AS total FROM c x JOIN c y ON y.b = x.b AND y.r = 1 AND y.k <> x.k JOIN c z ON z.b = x.b AND z.r = 2 AND z.k NOT IN (x.k, y.k) JOIN c w ON w.b = x.b AND w.r = 3 AND w.k NOT IN (x.k, y.k, z.k) WHERE x.r = 0)
SELECT b AS batch, min(total) AS cost FROM p GROUP BY 1""")
def _(spark, d):
    n = spark.range(96).select(F.floor(F.col("id") / 16).alias("batch"), F.floor(F.col("id") / 4 % 4).alias("row"), (F.col("id") % 4).alias("col"))
    r, k = F.col("row"), F.col("col")
    costs = n.withColumn("cost", ((F.col("batch") * 31 + r * 17 + k * k * 7 + r * k * 13) % 29).cast("double"))
    return op.linear_assignment(costs).groupBy("batch").agg(F.sum("cost").alias("cost"))
