"""Element-wise maps, reductions, broadcasts and movement of dense matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import elementwise as fn
from tessera.operators import dense as op
from tessera.queries.common import E, emb_cells, emb_keys, emb_rows, table
from tessera.registry import register

_KEY = "l_orderkey, l_linenumber"


def _cellwise(name: str, expr, sql: str) -> None:
    """A projection of lineitem: x = l_quantity - 25, y = l_discount, z = l_tax, p = l_extendedprice."""

    def run(spark, d):
        t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_extendedprice").alias("p"))
        return t.select("l_orderkey", "l_linenumber", expr(*map(F.col, "xyzp")).alias("v"))

    register(name, f"WITH t AS (SELECT {_KEY}, l_quantity - 25 AS x, l_discount AS y, l_tax AS z, l_extendedprice AS p FROM lineitem) SELECT {_KEY}, {sql} AS v FROM t")(run)


def _divide(p, x):
    """p / x; over 0 a null p gives NaN and a NaN, which is above every number, infinity, as the query's SQL has them."""
    odd = F.when(p.isNull(), F.lit("NaN").cast("double")).when(F.isnan(p), F.lit("Infinity").cast("double"))
    return F.when((x == 0) & (p.isNull() | F.isnan(p)), odd).otherwise(fn.divide(p, x))


_cellwise("map", lambda x, y, z, p: p * (1 - y) * (1 + z), "p * (1 - y) * (1 + z)")
_cellwise("unary_op", lambda x, y, z, p: fn.compose(fn.UNARY["sq"], fn.UNARY["abs"])(x), "abs(x) * abs(x)")
_cellwise("binary_op", lambda x, y, z, p: fn.BINARY["sub"](p, x), "p - x")
_cellwise("ternary_op", lambda x, y, z, p: x * y + z, "x * y + z")
_cellwise("add", lambda x, y, z, p: x + p, "x + p")
_cellwise("add_scalar", lambda x, y, z, p: fn.const_op("add", 2.5)(x), "x + 2.5::DOUBLE")
_cellwise("subtract", lambda x, y, z, p: x - p, "x - p")
_cellwise("multiply", lambda x, y, z, p: x * p, "x * p")
_cellwise("multiply_scalar", lambda x, y, z, p: fn.const_op("mul", 3.0)(x), "x * 3::DOUBLE")
_cellwise("divide", lambda x, y, z, p: _divide(p, x), "CASE WHEN x = 0 THEN CASE WHEN p > 0 THEN 'inf'::DOUBLE WHEN p < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE p / x END")
_cellwise("divide_check_zero", lambda x, y, z, p: fn.divide_check_zero(p, x), "CASE WHEN x = 0 THEN 0::DOUBLE ELSE p / x END")
_cellwise("power", lambda x, y, z, p: F.round(F.pow(x, F.lit(2.0)), 6), "round(pow(x, 2), 6)")
_cellwise("sqrt", lambda x, y, z, p: F.round(F.sqrt(p), 6), "round(sqrt(p), 6)")
_cellwise("weighted_sqrt", lambda x, y, z, p: F.round(fn.weighted_sqrt(x, 2.0, True), 6), "CASE WHEN x < 0 THEN 0 ELSE round(sqrt(2 * x), 6) END")
_cellwise("weighted_power", lambda x, y, z, p: fn.weighted_power(x, 0.5), "0.5::DOUBLE * x * x")
_cellwise("reciprocal", lambda x, y, z, p: fn.reciprocal(x, 2.0, True), "CASE WHEN abs(x) <= 1e-15 THEN 0::DOUBLE ELSE 2.0::DOUBLE / x END")
_cellwise("zero_small_values", lambda x, y, z, p: fn.zero_small(y, 0.03), "CASE WHEN abs(y) <= 0.03::DOUBLE THEN 0::DOUBLE ELSE y END")
_cellwise("functors", lambda x, y, z, p: fn.UNARY["nz"](x) + fn.UNARY["sgn"](x) + fn.BINARY["max"](x, y) + fn.BINARY["mod"](p, F.lit(7.0)) * 0, "CASE WHEN x <> 0 THEN 1::DOUBLE ELSE 0::DOUBLE END + sign(x) + greatest(x, y)")
_cellwise("compose_functors", lambda x, y, z, p: fn.map_args(fn.BINARY["add"], fn.UNARY["abs"], fn.const_op("mul", 2.0))(x, p), "abs(x) + p * 2::DOUBLE")
_cellwise("math", lambda x, y, z, p: F.round(F.sin(x) + F.cos(x) + F.tanh(y) + F.exp(z) + F.asin(y) + F.acos(y) + F.atanh(y) + fn.log(p), 6), "round(sin(x) + cos(x) + tanh(y) + exp(z) + asin(y) + acos(y) + atanh(y) + ln(p), 6)")
_cellwise("compare_functors", lambda x, y, z, p: fn.BINARY["greater_or_equal"](x, y) & fn.BINARY["notequal"](y, z), "x >= y AND y <> z")


@register("map_offset", f"WITH {E} SELECT \"row\", \"col\", val * \"col\" AS val FROM e")
def _(spark, d):
    return op.to_long(op.map_offset(emb_rows(spark, d), lambda i, x: x * i))


@register("ratio", f"WITH {E} SELECT \"row\", \"col\", round(val / (SELECT sum(val) FROM e), 9) AS val FROM e")
def _(spark, d):
    return op.ratio(emb_cells(spark, d)).withColumn("val", F.round("val", 9))


@register("fill", 'SELECT range AS "row", [2.5::DOUBLE, 2.5::DOUBLE, 2.5::DOUBLE] AS vec FROM range(100)')
def _(spark, d):
    return op.fill(spark, 100, 3, 2.5)


@register("range_zero", "SELECT range - 5 AS i, range AS v FROM range(5, 105)")
def _(spark, d):
    return op.value_range(spark, 5, 105)


@register("axpy", "SELECT o_orderkey AS i, 0.5::DOUBLE * o_totalprice + o_custkey::DOUBLE AS v FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return op.axpy(o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), o.select(F.col("o_orderkey").alias("i"), F.col("o_custkey").cast("double").alias("v")), 0.5)


@register("reduce", f"WITH {E} SELECT \"col\" AS i, round(sqrt(sum(val * val)), 6) AS v FROM e GROUP BY 1")
def _(spark, d):
    return op.reduce_cells(emb_cells(spark, d), "col", lambda x: x * x, F.sum, F.sqrt).withColumn("v", F.round("v", 6))


@register("reduce_onto", f'WITH {E} SELECT "row" AS i, round(sqrt(sum(val * val) + any_value(label)), 6) AS v FROM e JOIN embeddings ON vec_id = "row" GROUP BY 1')
def _(spark, d):
    old = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v"))
    return op.reduce_cells(emb_cells(spark, d), "row", lambda x: x * x, F.sum, F.sqrt, old).withColumn("v", F.round("v", 6))


@register("coalesced_reduction", f"WITH {E} SELECT \"row\" AS i, round(sum(val), 6) AS v FROM e GROUP BY 1")
def _(spark, d):
    return emb_rows(spark, d).select(F.col("row").alias("i"), F.round(op.compensated_sum(F.col("vec")), 6).alias("v"))


@register("strided_reduction", f"WITH {E} SELECT \"col\" AS i, round(sum(abs(val)), 6) AS v FROM e GROUP BY 1")
def _(spark, d):
    return op.reduce_cells(emb_cells(spark, d), "col", F.abs).withColumn("v", F.round("v", 6))


@register("reduce_fold", f"WITH {E} SELECT \"row\" AS i, max(abs(val)) AS v FROM e GROUP BY 1")
def _(spark, d):
    return op.reduce_rows(emb_rows(spark, d), 0.0, F.abs, F.greatest)


@register("map_reduce", "SELECT round(sum(l_quantity * l_discount), 4) AS v FROM lineitem")
def _(spark, d):
    return op.map_reduce(table(spark, d, "lineitem"), F.col("l_quantity") * F.col("l_discount"), F.sum, 0.0).withColumn("v", F.round("v", 4))


@register("reduce_rows_by_key", f"WITH {E} SELECT label::BIGINT AS key, \"col\", round(sum(val * (\"row\" % 3)), 6) AS val FROM e JOIN embeddings ON vec_id = \"row\" GROUP BY 1, 2")
def _(spark, d):
    keys = emb_keys(spark, d)
    return op.reduce_rows_by_key(emb_cells(spark, d), keys, keys.select("row", (F.col("row") % 3).cast("double").alias("w"))).withColumn("val", F.round("val", 6))


@register("reduce_rows_by_key_onto", f'WITH {E} SELECT label::BIGINT AS key, "col", round(sum(val) + any_value(label * 100 + "col"), 6) AS val FROM e JOIN embeddings ON vec_id = "row" GROUP BY 1, 2')
def _(spark, d):
    keys = emb_keys(spark, d)
    old = keys.select("key").distinct().crossJoin(spark.range(64).select(F.col("id").alias("col"))).select("key", "col", (F.col("key") * 100 + F.col("col")).cast("double").alias("val"))
    return op.reduce_rows_by_key(emb_cells(spark, d), keys, old=old).withColumn("val", F.round("val", 6))


@register("reduce_cols_by_key", f"WITH {E} SELECT \"row\", \"col\" % 5 AS key, round(sum(val), 6) AS val FROM e GROUP BY 1, 2")
def _(spark, d):
    keys = spark.range(64).select(F.col("id").alias("col"), (F.col("id") % 5).alias("key"))
    return op.reduce_cols_by_key(emb_cells(spark, d), keys).withColumn("val", F.round("val", 6))


@register("dense_grid", """WITH g AS (SELECT n_regionkey AS a, n_nationkey AS b, 1::DOUBLE AS v FROM nation)
SELECT x.range AS a, y.range AS b, coalesce(v, 0) AS val FROM range(5) x CROSS JOIN range(25) y LEFT JOIN g ON a = x.range AND b = y.range""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"), F.lit(1.0).alias("val"))
    return op.dense_grid(n, spark, "a", 5, "b", 25)


for _kind, _sql in (("L0", "sum((val <> 0)::INT)::DOUBLE"), ("L1", "round(sum(abs(val)), 6)"), ("L2", "round(sum(val * val), 6)"), ("Linf", "max(abs(val))")):

    @register(f"norm_{_kind.lower()}", f"WITH {E} SELECT \"row\" AS i, {_sql} AS v FROM e GROUP BY 1")
    def _(spark, d, kind=_kind):
        return op.norm(emb_rows(spark, d), kind).withColumn("v", F.round("v", 6) if kind in ("L1", "L2") else F.col("v"))


@register("normalize", f"WITH {E} SELECT \"row\", \"col\", round(val / sqrt(sum(val * val) OVER (PARTITION BY \"row\")), 6) AS val FROM e")
def _(spark, d):
    return op.to_long(op.normalize(emb_rows(spark, d))).withColumn("val", F.round("val", 6))


@register("dot", "SELECT round(sum(o_totalprice * (o_custkey % 7)), 2) AS v FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return op.dot(o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), o.select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 7).cast("double").alias("v"))).withColumn("v", F.round("v", 2))


@register("mse", "SELECT round(sum(0.5 * (l_discount - l_tax) * (l_discount - l_tax)) / count(*), 9) AS v FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem").withColumn("i", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    diff = F.col("l_discount") - F.col("l_tax")
    return t.agg(F.round(F.sum(F.lit(0.5) * diff * diff) / F.count("*"), 9).alias("v"))


@register("matrix_l2_norm", f"WITH {E} SELECT round(sqrt(sum(val * val)), 6) AS v FROM e")
def _(spark, d):
    return emb_cells(spark, d).agg(F.round(F.sqrt(F.sum(F.col("val") * F.col("val"))), 6).alias("v"))


for _name, _big, _f in (("argmax", True, "max"), ("argmin", False, "min")):

    @register(_name, f"WITH {E}, b AS (SELECT \"row\" AS r, {_f}(val) AS m FROM e GROUP BY 1) SELECT r AS i, min(\"col\") AS v FROM e JOIN b ON r = \"row\" AND val = m GROUP BY 1")
    def _(spark, d, big=_big):
        return op.arg_best(emb_rows(spark, d), big)


@register("linewise_op", f"WITH {E}, m AS (SELECT \"col\" AS c, avg(val) AS mu, max(val) AS mx FROM e GROUP BY 1) SELECT \"row\", \"col\", round((val - mu) / mx, 6) AS val FROM e JOIN m ON c = \"col\"")
def _(spark, d):
    cells = emb_cells(spark, d)
    stats = cells.groupBy(F.col("col").alias("i")).agg(F.avg("val").alias("mu"), F.max("val").alias("mx"))
    mu, mx = stats.select("i", F.col("mu").alias("v")), stats.select("i", F.col("mx").alias("v"))
    return op.matrix_vector(cells, mu, lambda x, a, b: F.round((x - a) / b, 6), "col", mx)


@register("matrix_vector_op", f"WITH {E} SELECT \"row\", \"col\", val + label AS val FROM e JOIN embeddings ON vec_id = \"row\"")
def _(spark, d):
    v = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v"))
    return op.matrix_vector(emb_cells(spark, d), v, lambda x, y: x + y, "row")


@register("binary_mult", f"WITH {E} SELECT \"row\", \"col\", CASE WHEN label = 0 THEN val ELSE val * label END AS val FROM e JOIN embeddings ON vec_id = \"row\"")
def _(spark, d):
    v = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v"))
    return op.matrix_vector(emb_cells(spark, d), v, op.mult_skip_zero, "row")


@register("binary_div_skip_zero", f"WITH {E} SELECT \"row\", \"col\", CASE WHEN label = 0 THEN 0 ELSE val / label END AS val FROM e JOIN embeddings ON vec_id = \"row\"")
def _(spark, d):
    v = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v"))
    return op.matrix_vector(emb_cells(spark, d), v, lambda x, y: op.div_skip_zero(x, y, True), "row")


_ROWS = f"SELECT \"row\", list(val ORDER BY \"col\") AS vec"


@register("copy_rows", f"WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT s.vec_id AS \"row\", \"col\", val FROM embeddings s, n JOIN e ON (s.vec_id * 7) % n = \"row\"")
def _(spark, d):
    ids = emb_keys(spark, d)
    n = F.broadcast(ids.agg(F.count("*").alias("n")))
    return op.gather(emb_cells(spark, d), ids.join(n).select(F.col("row").alias("i"), ((F.col("row") * 7) % F.col("n")).alias("src")))


@register("gather", f"WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT s.vec_id AS \"row\", \"col\", val FROM embeddings s, n JOIN e ON (s.vec_id * 3 + 1) % n = \"row\"")
def _(spark, d):
    ids = emb_keys(spark, d)
    n = F.broadcast(ids.agg(F.count("*").alias("n")))
    return op.gather(emb_cells(spark, d), ids.join(n).select(F.col("row").alias("i"), (F.col("row") * 3 + 1).alias("src"), "n").select("i", (F.col("src") % F.col("n")).alias("src")))


@register("gather_if", f"WITH {E} SELECT vec_id AS \"row\", \"col\", val FROM embeddings JOIN e ON vec_id = \"row\" WHERE label > 5")
def _(spark, d):
    index = emb_keys(spark, d).select(F.col("row").alias("i"), F.col("row").alias("src"), F.col("key").alias("stencil"))
    return op.gather_if(emb_cells(spark, d), index, lambda s: s > 5)


@register("scatter", f"WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT n - 1 - \"row\" AS \"row\", \"col\", val FROM e, n")
def _(spark, d):
    ids = emb_keys(spark, d)
    n = F.broadcast(ids.agg(F.count("*").alias("n")))
    return op.scatter(emb_cells(spark, d), ids.join(n).select(F.col("row").alias("i"), (F.col("n") - 1 - F.col("row")).alias("dst")))


@register("slice", f"WITH {E} SELECT \"row\" - 10 AS \"row\", \"col\" - 4 AS \"col\", val FROM e WHERE \"row\" >= 10 AND \"row\" < 60 AND \"col\" >= 4 AND \"col\" < 20")
def _(spark, d):
    return op.slice_cells(emb_cells(spark, d), 10, 60, 4, 20)


@register("reverse_cols", f"WITH {E} SELECT \"row\", 63 - \"col\" AS \"col\", val FROM e")
def _(spark, d):
    return op.to_long(op.reverse_cols(emb_rows(spark, d)))


@register("reverse_rows", f"WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT n - 1 - \"row\" AS \"row\", \"col\", val FROM e, n")
def _(spark, d):
    return op.reverse_rows(emb_cells(spark, d), table(spark, d, "embeddings").count())


@register("shift_cols", f"WITH {E} SELECT \"row\", \"col\" + 3 AS \"col\", val FROM e WHERE \"col\" < 61 UNION ALL SELECT vec_id, range, 100 FROM embeddings, range(3)")
def _(spark, d):
    return op.to_long(op.shift_cols(emb_rows(spark, d), 3, 100.0))


@register("shift_rows", f"WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT \"row\" + 2 AS \"row\", \"col\", val FROM e, n WHERE \"row\" < n - 2 UNION ALL SELECT \"row\", \"col\", 7 FROM e WHERE \"row\" < 2")
def _(spark, d):
    return op.to_long(op.shift_rows(emb_rows(spark, d), table(spark, d, "embeddings").count(), 2, 7.0))


@register("copy_top_left", f'WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT "row", "col", val FROM e, n WHERE "row" < n // 2 AND "col" < 32')
def _(spark, d):
    return op.top_left(emb_cells(spark, d), table(spark, d, "embeddings").count() // 2, 32)


@register("shift_cols_own_row", f'WITH {E} SELECT "row", "col" - 3 AS "col", val FROM e WHERE "col" >= 3 UNION ALL SELECT vec_id, 61 + range, vec_id::DOUBLE FROM embeddings, range(3)')
def _(spark, d):
    return op.to_long(op.shift_cols(emb_rows(spark, d), 3, to_end=False))


@register("shift_cols_matrix", f'WITH {E} SELECT "row", "col" + 2 AS "col", val FROM e WHERE "col" < 62 UNION ALL SELECT vec_id, range, (vec_id + range)::DOUBLE FROM embeddings, range(2)')
def _(spark, d):
    filling = emb_keys(spark, d).select("row", F.array(F.col("row").cast("double"), (F.col("row") + 1).cast("double")).alias("vec"))
    return op.to_long(op.shift_cols(emb_rows(spark, d), 2, filling))


@register("shift_rows_own_row", f'WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT "row" - 2 AS "row", "col", val FROM e WHERE "row" >= 2 UNION ALL SELECT "row", "col", "row"::DOUBLE FROM e, n WHERE "row" >= n - 2')
def _(spark, d):
    return op.to_long(op.shift_rows(emb_rows(spark, d), table(spark, d, "embeddings").count(), 2, to_end=False))


@register("shift_rows_matrix", f'WITH {E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT "row" + 2 AS "row", "col", val FROM e, n WHERE "row" < n - 2 UNION ALL SELECT range, "col", range + 0.5 FROM range(2), (SELECT DISTINCT "col" FROM e)')
def _(spark, d):
    filling = spark.range(2).select(F.col("id").alias("row"), F.array_repeat(F.col("id") + F.lit(0.5), 64).alias("vec"))
    return op.to_long(op.shift_rows(emb_rows(spark, d), table(spark, d, "embeddings").count(), 2, filling))


@register("triangular", f"WITH {E} SELECT * FROM e WHERE \"row\" < 64 AND \"col\" >= \"row\"")
def _(spark, d):
    return op.upper_triangle(emb_cells(spark, d), 100, 64)


@register("diagonal", f"WITH {E} SELECT \"row\" AS i, val AS v FROM e WHERE \"row\" = \"col\"")
def _(spark, d):
    return op.diagonal(emb_cells(spark, d))


@register("set_diagonal", f"WITH {E} SELECT \"row\", \"col\", CASE WHEN \"row\" = \"col\" THEN label ELSE val END AS val FROM e JOIN embeddings ON vec_id = \"row\"")
def _(spark, d):
    return op.set_diagonal(emb_cells(spark, d), emb_keys(spark, d).select(F.col("row").alias("i"), F.col("key").cast("double").alias("v")))


@register("invert_diagonal", f"WITH {E} SELECT \"row\", \"col\", CASE WHEN \"row\" = \"col\" THEN 1 / val ELSE val END AS val FROM e")
def _(spark, d):
    return op.invert_diagonal(emb_cells(spark, d))


@register("eye", 'SELECT range AS "row", range AS "col", 1::DOUBLE AS val FROM range(50)')
def _(spark, d):
    return op.eye(spark, 50)


@register("sign_flip", f"WITH {E}, m AS (SELECT \"col\" AS c, arg_max(val, (abs(val), -\"row\")) AS lead FROM e GROUP BY 1) SELECT \"row\", \"col\", CASE WHEN lead < 0 THEN -val ELSE val END AS val FROM e JOIN m ON c = \"col\"")
def _(spark, d):
    return op.sign_flip(emb_cells(spark, d))


@register("print", f"WITH {E} SELECT \"row\", string_agg(printf('%1.4f', val), ' ' ORDER BY \"col\") AS line FROM e GROUP BY 1")
def _(spark, d):
    return op.print_rows(emb_rows(spark, d))


@register("col_wise_sort", f"WITH {E} SELECT \"row\", list(\"col\" ORDER BY val, \"col\") AS \"order\", list(val ORDER BY val, \"col\") AS vec FROM e GROUP BY 1")
def _(spark, d):
    return op.sort_rows(emb_rows(spark, d))


for _name, _small, _dir in (("select_k", True, "ASC"), ("select_k_largest", False, "DESC")):

    @register(_name, f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY val {_dir}, \"col\") AS k FROM e) SELECT \"row\", list(val ORDER BY k) AS vals, list(\"col\" ORDER BY k) AS idx FROM r WHERE k <= 8 GROUP BY 1")
    def _(spark, d, small=_small):
        return op.select_k(emb_rows(spark, d), 8, small)


@register("select_k_payload", f'WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY val, "col") AS k FROM e) SELECT "row", list(val ORDER BY k) AS vals, list("row" * 100 + "col" ORDER BY k) AS idx FROM r WHERE k <= 8 GROUP BY 1')
def _(spark, d):
    rows = emb_rows(spark, d).withColumn("names", F.transform("vec", lambda x, i: F.col("row") * 100 + i))
    return op.select_k(rows, 8, payload="names")


@register("nearest_to_centroid", f"""WITH {E}, l AS (SELECT e.*, label FROM e JOIN embeddings ON vec_id = "row"),
m AS (SELECT label, "col", avg(val) AS mu FROM l GROUP BY 1, 2),
s AS (SELECT label, "row", sum((val - mu) * (val - mu)) AS d2 FROM l JOIN m USING (label, "col") GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, "row") AS rank FROM s)
SELECT label::BIGINT AS label, "row" AS vec_id, rank, round(d2, 6) AS d2 FROM r WHERE rank <= 3""")
def _(spark, d):
    cells = emb_cells(spark, d).join(emb_keys(spark, d), "row")
    centre = cells.groupBy("key", "col").agg(F.avg("val").alias("mu"))
    gap = F.col("val") - F.col("mu")
    far = cells.join(centre, ["key", "col"]).groupBy("key", "row").agg(F.sum(gap * gap).alias("d2"))
    best = op.select_k_cells(far.select(F.col("key").alias("row"), F.col("row").alias("col"), F.col("d2").alias("val")), 3)
    return best.select(F.col("row").alias("label"), F.col("col").alias("vec_id"), F.col("rank"), F.round("val", 6).alias("d2"))
