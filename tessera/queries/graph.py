"""Graph operators over customers, joined in rings inside nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as op
from tessera.queries.common import G, table, user_edges
from tessera.registry import register

_SYM = G + """, s AS (SELECT src AS "row", dst AS "col", w AS val FROM g UNION ALL SELECT dst, src, w FROM g)"""


def _cells(spark, d):
    e = user_edges(spark, d)
    return e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val")).unionByName(e.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("w").alias("val")))


@register("laplacian", f"""WITH {_SYM} SELECT "row", "col", round(sum(val), 2) AS val FROM (SELECT "row", "row" AS "col", val FROM s UNION ALL SELECT "row", "col", -val FROM s) GROUP BY 1, 2""")
def _(spark, d):
    return op.laplacian(_cells(spark, d)).withColumn("val", F.round("val", 2))


@register("laplacian_norm", f"""WITH {_SYM}, d AS (SELECT "row" AS k, sqrt(sum(val)) AS r FROM s GROUP BY 1)
SELECT "row", "col", round(-val / (a.r * b.r), 9) AS val FROM s JOIN d a ON a.k = "row" JOIN d b ON b.k = "col" UNION ALL SELECT k, k, 1 FROM d""")
def _(spark, d):
    return op.normalized_laplacian(_cells(spark, d)).withColumn("val", F.round("val", 9))


_REACH = """r AS (SELECT x, x AS y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON n.x = r.y)"""


@register("weak_cc", f"WITH RECURSIVE {G}, n AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), {_REACH} SELECT x AS id, min(y) + 1 AS label FROM r GROUP BY 1")
def _(spark, d):
    return op.weak_components(user_edges(spark, d))


@register("weak_cc_filtered", f"""WITH RECURSIVE {G}, u AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g),
n AS (SELECT x, y FROM u WHERE x % 5 <> 0 AND y % 5 <> 0 UNION SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 5 <> 0), {_REACH},
i AS (SELECT x, min(y) + 1 AS label FROM r GROUP BY 1)
SELECT x AS id, label FROM i UNION ALL SELECT c_custkey, (SELECT min(label) FROM u JOIN i ON i.x = u.y WHERE u.x = c_custkey) FROM customer WHERE c_custkey % 5 = 0""")
def _(spark, d):
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 != 0).alias("allowed"))
    return op.weak_components(user_edges(spark, d), v)


@register("mst")
def _(spark, d):
    return op.minimum_spanning_forest(user_edges(spark, d))


@register("mst_weight", """WITH RECURSIVE n AS (SELECT c_nationkey AS n, round(abs(c_acctbal) + 1, 2) AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
r AS (SELECT n, i, 0::DOUBLE AS total, 0::DOUBLE AS top FROM n WHERE i = 1 UNION ALL
  SELECT n, i, total + w + CASE WHEN hub THEN 2 * w - m ELSE 0 END, CASE WHEN hub THEN 2 * w ELSE m END
  FROM (SELECT n.n, n.i, w, total, greatest(top, w) AS m, n.i > 2 AND n.i % 3 = 0 AND 2 * w < greatest(top, w) AS hub FROM r JOIN n ON n.n = r.n AND n.i = r.i + 1))
SELECT n AS nation, count(*) - 1 AS edges, round(arg_max(total, i), 2) AS weight FROM r GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    found = op.minimum_spanning_forest(user_edges(spark, d))
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("nation"))
    return found.join(nation, "src").groupBy("nation").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


_CL = "k AS (SELECT c_custkey AS id, (c_nationkey * 2 + c_custkey % 2)::BIGINT AS cluster FROM customer), x AS (SELECT g.*, a.cluster AS cs, b.cluster AS cd FROM g JOIN k a ON a.id = src JOIN k b ON b.id = dst)"


def _clusters(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 2 + F.col("c_custkey") % 2).cast("long").alias("cluster"))


@register("spectral_partition", f"""WITH {G}, {_CL}, l AS (SELECT cs AS c, w FROM x WHERE cs <> cd UNION ALL SELECT cd, w FROM x WHERE cs <> cd), s AS (SELECT cluster AS c, count(*) AS n FROM k GROUP BY 1)
SELECT round(sum(w) / 2, 2) AS edge_cut, round(sum(w / n), 4) AS cost FROM l JOIN s USING (c)""")
def _(spark, d):
    return op.partition_quality(user_edges(spark, d), _clusters(spark, d)).select(F.round("edge_cut", 2).alias("edge_cut"), F.round("cost", 4).alias("cost"))


@register("modularity", f"""WITH {G}, {_CL}, t AS (SELECT 2 * sum(w) AS t FROM g), dg AS (SELECT c, sum(w) AS dg FROM (SELECT cs AS c, w FROM x UNION ALL SELECT cd, w FROM x) GROUP BY 1),
i AS (SELECT cs AS c, sum(2 * w) AS i FROM x WHERE cs = cd GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / t - (dg / t) * (dg / t)), 9) AS v FROM dg LEFT JOIN i USING (c), t""")
def _(spark, d):
    return op.modularity(user_edges(spark, d), _clusters(spark, d)).withColumn("v", F.round("v", 9))
