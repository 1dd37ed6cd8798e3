"""Statistics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as op
from tessera.queries.common import E, emb_cells, emb_keys, emb_rows, table
from tessera.registry import register


@register("mean", f'WITH {E} SELECT "col" AS i, round(avg(val), 9) AS v FROM e GROUP BY 1')
def _(spark, d):
    return op.column_means(emb_cells(spark, d)).withColumn("v", F.round("v", 9))


@register("sum", f'WITH {E} SELECT "col" AS i, round(sum(val), 6) AS v FROM e GROUP BY 1')
def _(spark, d):
    return op.column_sums(emb_cells(spark, d)).withColumn("v", F.round("v", 6))


for _name, _f in (("vars", "var_samp"), ("stddev", "stddev_samp")):

    @register(_name, f'WITH {E} SELECT "col" AS i, round({_f}(val), 9) AS v FROM e GROUP BY 1')
    def _(spark, d, root=_name == "stddev"):
        cells = emb_cells(spark, d)
        return op.variances(cells, op.column_means(cells), True, root).withColumn("v", F.round("v", 9))


@register("meanvar", f'WITH {E} SELECT "col" AS i, round(avg(val), 9) AS mean, round(var_samp(val), 9) AS var FROM e GROUP BY 1')
def _(spark, d):
    return op.mean_var(emb_cells(spark, d)).select("i", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


@register("cov", f'WITH {E} SELECT a."col" AS "row", b."col" AS "col", round(covar_samp(a.val, b.val), 9) AS val FROM e a JOIN e b ON a."row" = b."row" GROUP BY 1, 2')
def _(spark, d):
    return op.covariance(emb_rows(spark, d)).withColumn("val", F.round("val", 9))


for _name, _sign in (("mean_center", "-"), ("mean_add", "+")):

    @register(_name, f'WITH {E} SELECT "row", "col", round(val {_sign} avg(val) OVER (PARTITION BY "col"), 9) AS val FROM e')
    def _(spark, d, add=_sign == "+"):
        return op.mean_center(emb_cells(spark, d), add).withColumn("val", F.round("val", 9))


@register("minmax", f'WITH {E} SELECT "col" AS i, min(val) AS lo, max(val) AS hi FROM e GROUP BY 1')
def _(spark, d):
    return op.min_max(emb_cells(spark, d))


@register("minmax_sampled", f'WITH {E} SELECT "col" AS i, min(val) AS lo, max(val) AS hi FROM e JOIN embeddings ON vec_id = "row" WHERE label < 3 AND "col" % 2 = 0 GROUP BY 1')
def _(spark, d):
    rows = emb_keys(spark, d).where("key < 3").select("row")
    return op.min_max(emb_cells(spark, d), rows, spark.range(0, 64, 2).select(F.col("id").alias("col")))


@register("weighted_mean", f'WITH {E} SELECT "row" AS i, round(sum(val * ("col" + 1)) / sum("col" + 1), 9) AS v FROM e GROUP BY 1')
def _(spark, d):
    w = spark.range(64).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("w"))
    return op.weighted_mean(emb_cells(spark, d), w).withColumn("v", F.round("v", 9))


@register("col_weighted_mean", f'WITH {E} SELECT "col" AS i, round(sum(val * (label + 1)) / sum(label + 1), 9) AS v FROM e JOIN embeddings ON vec_id = "row" GROUP BY 1')
def _(spark, d):
    w = emb_keys(spark, d).select(F.col("row").alias("i"), (F.col("key") + 1).cast("double").alias("w"))
    return op.weighted_mean(emb_cells(spark, d), w, "col").withColumn("v", F.round("v", 9))


@register("histogram", """WITH l AS (SELECT c, least(9, floor(v / 10))::BIGINT AS bin FROM (SELECT 0 AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 1, l_discount * 1000 FROM lineitem)),
n AS (SELECT c, bin, count(*) AS n FROM l GROUP BY 1, 2)
SELECT g.c::BIGINT AS "col", b.range AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT c FROM l) g CROSS JOIN range(10) b LEFT JOIN n ON n.c = g.c AND n.bin = b.range""")
def _(spark, d):
    t = table(spark, d, "lineitem")
    q = t.select(F.col("l_orderkey").alias("row"), F.lit(0).cast("long").alias("col"), F.col("l_quantity").alias("val"))
    x = t.select(F.col("l_orderkey").alias("row"), F.lit(1).cast("long").alias("col"), (F.col("l_discount") * 1000).alias("val"))
    return op.histogram(q.unionByName(x), 10, lambda v, r, c: F.least(F.lit(9), F.floor(v / 10)))


def _preds(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("i"), F.col("toxic").alias("y"), (1 - F.col("quality")).alias("y_hat"))


@register("accuracy", "SELECT round(avg((toxic = 1 - quality)::INT), 9) AS v FROM labels")
def _(spark, d):
    return op.accuracy(_preds(spark, d)).withColumn("v", F.round("v", 9))


def _price(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("y"), (F.lit(900.0) + F.col("p_size") * 4).alias("y_hat"))


@register("r2_score", "WITH m AS (SELECT avg(p_retailprice) AS m FROM part) SELECT round(1 - sum(pow(p_retailprice - 900 - p_size * 4, 2)) / sum(pow(p_retailprice - m, 2)), 6) AS v FROM part, m")
def _(spark, d):
    return op.r2_score(_price(spark, d)).withColumn("v", F.round("v", 6))


@register("regression_metrics", "WITH e AS (SELECT p_retailprice - 900 - p_size * 4 AS e FROM part) SELECT round(avg(abs(e)), 4) AS mean_abs, round(avg(e * e), 3) AS mean_sq, round(median(abs(e)), 4) AS median_abs FROM e")
def _(spark, d):
    return op.regression_metrics(_price(spark, d)).select(F.round("mean_abs", 4).alias("mean_abs"), F.round("mean_sq", 3).alias("mean_sq"), F.round("median_abs", 4).alias("median_abs"))


for _kind, _sql in (("AIC", "2 * 5"), ("AICc", "2 * (5 + 5 * 6 / (52 - 5 - 1))"), ("BIC", "5 * ln(52)")):

    @register(f"information_criterion_{_kind.lower()}", f"SELECT p_partkey AS i, round({_sql} - 2 * (-p_retailprice), 6) AS v FROM part")
    def _(spark, d, kind=_kind):
        ll = table(spark, d, "part").select(F.col("p_partkey").alias("i"), (-F.col("p_retailprice")).alias("loglike"))
        return op.information_criterion(ll, kind, 5, 52).withColumn("v", F.round("v", 6))


def _labelled(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("truth"), F.when(F.col("embedding")[0] > 0, F.col("label")).otherwise(F.col("vec_id") % 10).cast("long").alias("pred"))


_LP = "lp AS (SELECT label::BIGINT AS truth, CASE WHEN embedding[1] > 0 THEN label ELSE vec_id % 10 END::BIGINT AS pred FROM embeddings)"


@register("contingency_matrix", f"WITH {_LP}, c AS (SELECT truth AS t, pred AS p, count(*) AS k FROM lp GROUP BY 1, 2) SELECT a.range AS truth, b.range AS pred, coalesce(k, 0) AS n FROM range(10) a CROSS JOIN range(10) b LEFT JOIN c ON t = a.range AND p = b.range")
def _(spark, d):
    return op.contingency_matrix(_labelled(spark, d), spark, 0, 9)


_SCORES = f"""WITH {_LP}, n AS (SELECT count(*)::DOUBLE AS n FROM lp), c AS (SELECT truth, pred, count(*)::DOUBLE AS k FROM lp GROUP BY 1, 2),
a AS (SELECT truth, sum(k) AS a FROM c GROUP BY 1), b AS (SELECT pred, sum(k) AS b FROM c GROUP BY 1),
ht AS (SELECT -sum(a / n * ln(a / n)) AS ht, sum(a * (a - 1) / 2) AS sa FROM a, n), hp AS (SELECT -sum(b / n * ln(b / n)) AS hp, sum(b * (b - 1) / 2) AS sb FROM b, n),
mi AS (SELECT sum(k / n * (ln(n * k) - ln(a * b))) AS mi, sum(k * (k - 1) / 2) AS sk FROM c JOIN a USING (truth) JOIN b USING (pred), n),
s AS (SELECT *, mi / ht AS h, mi / hp AS c, n * (n - 1) / 2 AS t FROM ht, hp, mi, n)
SELECT """
for _name, _mine, _sql in (
    ("entropy", "entropy_truth", "ht"),
    ("mutual_info", "mutual_info", "mi"),
    ("homogeneity", "homogeneity", "h"),
    ("completeness", "completeness", "c"),
    ("v_measure", "v_measure", "2 * h * c / (h + c)"),
    ("rand_index", "rand_index", "(t + 2 * sk - sa - sb) / t"),
    ("adjusted_rand", "adjusted_rand", "(sk - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)"),
):

    @register(_name, f"{_SCORES} round({_sql}, 9) AS v FROM s")
    def _(spark, d, column=_mine):
        return op.label_scores(_labelled(spark, d)).select(F.round(column, 9).alias("v"))


@register("kl_divergence", """WITH p AS (SELECT o_orderpriority AS i, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS p, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) AS q FROM orders GROUP BY 1)
SELECT round(sum(p * (ln(p) - ln(q))), 9) AS v FROM p""")
def _(spark, d):
    o = table(spark, d, "orders")
    total = F.broadcast(o.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t")))
    p = o.groupBy("o_orderpriority").agg(F.count("*").alias("c"), F.sum("o_totalprice").alias("s")).join(total)
    return op.kl_divergence(p.select((F.col("c") / F.col("n")).alias("p"), (F.col("s") / F.col("t")).alias("q"))).withColumn("v", F.round("v", 9))


@register("dispersion", f"""WITH {E}, x AS (SELECT label, "col", avg(val) AS m, count(*) AS n FROM e JOIN embeddings ON vec_id = "row" GROUP BY 1, 2),
g AS (SELECT "col", sum(m * n) / sum(n) AS c FROM x GROUP BY 1) SELECT round(sqrt(sum(n * (m - c) * (m - c))), 6) AS v FROM x JOIN g USING ("col")""")
def _(spark, d):
    cells = emb_cells(spark, d).join(emb_keys(spark, d), "row")
    return op.dispersion(cells.groupBy("key", "col").agg(F.avg("val").alias("val")), emb_keys(spark, d).groupBy("key").agg(F.count("*").alias("n"))).withColumn("v", F.round("v", 6))


_D2 = f"""WITH {E}, d AS (SELECT a."row" AS i, b."row" AS j, sum((a.val - b.val) * (a.val - b.val)) AS d FROM e a JOIN e b ON a."col" = b."col" GROUP BY 1, 2)"""


@register("silhouette", _D2 + """, m AS (SELECT i, y.label AS c, sum(d) AS s, count(*) AS n, any_value(x.label) AS own FROM d JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j GROUP BY 1, 2),
p AS (SELECT i, max(CASE WHEN c = own AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> own THEN s / n END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS v FROM p""")
def _(spark, d):
    points = emb_rows(spark, d).join(emb_keys(spark, d).withColumnRenamed("key", "label"), "row")
    return op.silhouette(points).withColumn("v", F.round("v", 9))


_SIL = """, m AS (SELECT i, y.label AS c, sum(d) AS s, count(*) AS n, any_value(x.label) AS own FROM d JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j GROUP BY 1, 2),
p AS (SELECT i, max(CASE WHEN c = own AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> own THEN s / n END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS v FROM p"""
for _metric, _dist in (("cosine", "1 - sum(a.val * b.val) / sqrt(sum(a.val * a.val)) / sqrt(sum(b.val * b.val))"), ("euclidean", "sqrt(sum((a.val - b.val) * (a.val - b.val)))"), ("l1", "sum(abs(a.val - b.val))"), ("linf", "max(abs(a.val - b.val))")):

    @register(f"silhouette_{_metric}", f'WITH {E}, d AS (SELECT a."row" AS i, b."row" AS j, {_dist} AS d FROM e a JOIN e b ON a."col" = b."col" GROUP BY 1, 2)' + _SIL)
    def _(spark, d, metric=_metric):
        points = emb_rows(spark, d).join(emb_keys(spark, d).withColumnRenamed("key", "label"), "row")
        return op.silhouette(points, metric).withColumn("v", F.round("v", 9))


def _half(spark, d):
    return emb_rows(spark, d).select("row", F.slice("vec", 1, 16).alias("vec"))


@register("trustworthiness", _D2 + """, h AS (SELECT a."row" AS i, b."row" AS j, sum((a.val - b.val) * (a.val - b.val)) AS d FROM e a JOIN e b ON a."col" = b."col" WHERE a."col" < 16 GROUP BY 1, 2),
o AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d WHERE i <> j), k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM h WHERE i <> j),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT round(1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(greatest(0, o.r - 5)), 9) AS v FROM k JOIN o USING (i, j), n WHERE k.r <= 5""")
def _(spark, d):
    return op.trustworthiness(emb_rows(spark, d), _half(spark, d), 5).withColumn("v", F.round("v", 9))


@register("neighborhood_recall", _D2 + """, h AS (SELECT a."row" AS i, b."row" AS j, sum((a.val - b.val) * (a.val - b.val)) AS d FROM e a JOIN e b ON a."col" = b."col" WHERE a."col" < 16 GROUP BY 1, 2),
o AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d WHERE i <> j), k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM h WHERE i <> j)
SELECT round(avg((o.j IS NOT NULL)::INT), 9) AS v FROM k LEFT JOIN (SELECT * FROM o WHERE r <= 5) o ON o.i = k.i AND o.j = k.j WHERE k.r <= 5""")
def _(spark, d):
    found = op.nearest(_half(spark, d), 5).select("row", F.col("other").alias("id"))
    truth = op.nearest(emb_rows(spark, d), 5).select("row", F.col("other").alias("id"))
    return op.neighborhood_recall(found, truth).withColumn("v", F.round("v", 9))
