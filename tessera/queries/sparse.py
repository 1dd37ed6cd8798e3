"""Sparse formats, row operators and products: orders by parts, and documents by words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sparse as op
from tessera.queries.common import OP, E, emb_rows, order_part, table
from tessera.registry import register

_CSR = 'csr AS (SELECT "row", list("col" ORDER BY "col") AS cols, list(val ORDER BY "col") AS vals FROM op GROUP BY 1)'


@register("coo_csr_types", f"WITH {OP} SELECT * FROM op")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    return op.coo(t)


@register("coo_to_csr", f"WITH {OP}, {_CSR} SELECT * FROM csr")
def _(spark, d):
    return op.coo_to_csr(order_part(spark, d))


@register("csr_to_coo", f"WITH {OP} SELECT * FROM op")
def _(spark, d):
    return op.csr_to_coo(op.coo_to_csr(order_part(spark, d)))


@register("csr_offsets", """WITH n AS (SELECT r.range AS "row", count(l_orderkey) AS n FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) r LEFT JOIN lineitem ON l_orderkey = r.range GROUP BY 1)
SELECT "row", coalesce(sum(n) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n""")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    last = t.agg(F.max("row")).first()[0]
    return op.row_offsets(t, spark, 0 if last is None else last + 1)


@register("adj_to_csr", 'SELECT vec_id AS "row", list_filter(range(64), lambda i: embedding[i + 1] > 0) AS cols FROM embeddings')
def _(spark, d):
    return op.adj_to_csr(emb_rows(spark, d).select("row", F.transform("vec", lambda x: x > 0).alias("flags")))


@register("bitmap_to_csr", """WITH w AS (SELECT range AS i, (range * 2654435761) % 4294967296 AS word FROM range(8))
SELECT (i * 32 + b.range) // 16 AS "row", list((i * 32 + b.range) % 16 ORDER BY (i * 32 + b.range) % 16) AS cols FROM w, range(32) b WHERE (word >> b.range) & 1 = 1 GROUP BY 1""")
def _(spark, d):
    words = spark.range(1).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: (i * F.lit(2654435761)) % F.lit(4294967296)).alias("words"))
    return op.bitmap_to_csr(words, 16, 16)


@register("bitset_to_csr", """WITH b AS (SELECT list(range ORDER BY range) AS cols FROM range(40) WHERE ((CASE WHEN range < 32 THEN 2863311530 ELSE 15 END) >> (range % 32)) & 1 = 1)
SELECT n_nationkey::BIGINT AS "row", cols FROM nation, b""")
def _(spark, d):
    words = spark.range(1).select(F.array(F.lit(2863311530), F.lit(15).cast("long")).alias("words"))
    return op.bitset_to_csr(spark, words, table(spark, d, "nation").count(), 40)


@register("csr_to_dense", """WITH c AS (SELECT l_orderkey AS r, l_linenumber AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey AS r FROM lineitem)
SELECT o.r AS "row", list(coalesce(v, 0) ORDER BY g.range) AS vec FROM o CROSS JOIN range(8) g LEFT JOIN c ON c.r = o.r AND c.c = g.range GROUP BY 1""")
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.sum("l_quantity").alias("val"))
    return op.csr_to_dense(op.coo_to_csr(t), 8)


@register("coo_sort", f"WITH {OP} SELECT * FROM op")
def _(spark, d):
    return op.coo_sort(order_part(spark, d))


@register("coo_sort_by_weight", f"WITH {OP} SELECT * FROM op")
def _(spark, d):
    return op.coo_sort(order_part(spark, d), by_weight=True)


@register("coo_filter", f"WITH {OP} SELECT * FROM op WHERE val <> 10")
def _(spark, d):
    return op.remove_scalar(order_part(spark, d), 10.0)


@register("max_duplicates", 'SELECT l_partkey AS "row", l_suppkey AS "col", max(l_quantity) AS val FROM lineitem GROUP BY 1, 2')
def _(spark, d):
    t = table(spark, d, "lineitem")
    return op.max_duplicates(t.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val")))


@register("csr_row_op", f'WITH {OP} SELECT "row", max(val) - min(val) AS v FROM op GROUP BY 1')
def _(spark, d):
    return op.csr_row_op(op.coo_to_csr(order_part(spark, d)), lambda c, v: F.array_max(v) - F.array_min(v))


@register("csr_row_slice", f'WITH {OP}, {_CSR} SELECT "row" - 100 AS "row", cols, vals FROM csr WHERE "row" BETWEEN 100 AND 400')
def _(spark, d):
    return op.csr_row_slice(op.coo_to_csr(order_part(spark, d)), 100, 400)


@register("degree", f'WITH {OP} SELECT "row", count(*) AS n FROM op GROUP BY 1')
def _(spark, d):
    return op.degree(order_part(spark, d))


@register("degree_not_equal", f'WITH {OP} SELECT "row", count(*) FILTER (WHERE val <> 10) AS n FROM op GROUP BY 1')
def _(spark, d):
    return op.degree(order_part(spark, d), 10.0)


@register("csr_add", f'WITH {OP}, u AS (SELECT * FROM op UNION ALL SELECT l_orderkey, l_suppkey, sum(l_discount) FROM lineitem GROUP BY 1, 2) SELECT "row", "col", round(sum(val), 6) AS val FROM u GROUP BY 1, 2')
def _(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_discount").alias("val"))
    return op.add(order_part(spark, d), b).withColumn("val", F.round("val", 6))


@register("csr_transpose", f'WITH {OP} SELECT "col" AS "row", list("row" ORDER BY "row") AS cols, list(val ORDER BY "row") AS vals FROM op GROUP BY 1')
def _(spark, d):
    return op.coo_to_csr(op.transpose(order_part(spark, d)))


for _kind, _sql in (("L1", "sum(abs(val))"), ("L2", "sum(val * val)"), ("Linf", "max(abs(val))")):

    @register(f"csr_norm_{_kind.lower()}", f'WITH {OP} SELECT "row", {_sql} AS v FROM op GROUP BY 1')
    def _(spark, d, kind=_kind):
        return op.csr_norm(op.coo_to_csr(order_part(spark, d)), kind)


for _kind, _sql in (("L1", "sum(abs(val))"), ("max", "max(val)")):

    @register(f"csr_row_normalize_{_kind.lower()}", f'WITH {OP} SELECT "row", "col", round(val / {_sql} OVER (PARTITION BY "row"), 9) AS val FROM op')
    def _(spark, d, kind=_kind):
        return op.csr_to_coo(op.csr_row_normalize(op.coo_to_csr(order_part(spark, d)), kind)).withColumn("val", F.round("val", 9))


_NN = """nn AS (SELECT c_nationkey::BIGINT AS "row", (c_custkey % 25)::BIGINT AS "col", sum(c_acctbal) AS val FROM customer GROUP BY 1, 2)"""


def _nation_cells(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("row"), (F.col("c_custkey") % 25).cast("long").alias("col")).agg(F.sum("c_acctbal").alias("val"))


@register("sparse_diagonal", f"""WITH {_NN}, dg AS (SELECT "row" AS k, val AS v FROM nn WHERE "row" = "col")
SELECT "row", "col", round(CASE WHEN coalesce(a.v, 0) * coalesce(b.v, 0) = 0 THEN 0 ELSE val / (a.v * b.v) END, 9) AS val FROM nn LEFT JOIN dg a ON a.k = "row" LEFT JOIN dg b ON b.k = "col" """)
def _(spark, d):
    return op.scale_by_diagonal(_nation_cells(spark, d)).withColumn("val", F.round("val", 9))


@register("sparse_set_diagonal", f"""WITH {_NN} SELECT "row", "col", CASE WHEN "row" = "col" THEN 1 ELSE round(val, 2) END AS val FROM nn""")
def _(spark, d):
    return op.set_diagonal(_nation_cells(spark, d).withColumn("val", F.round("val", 2)), 1.0)


def _words(spark, d):
    """Word counts of documents, words by their spelling. Texts move once, to their identifier; words and counts stay where they are."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("row"), "text").repartition("row")
    t = t.select("row", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("col"))
    return t.where("col <> ''").groupBy("row", "col").agg(F.count("*").cast("double").alias("val"))


_W = """w AS (SELECT "row", "col", count(*)::DOUBLE AS val FROM (SELECT doc_id AS "row", unnest(string_split(coalesce(text, ''), ' ')) AS "col" FROM documents) WHERE "col" <> '' GROUP BY 1, 2),
n AS (SELECT count(DISTINCT "row") AS n, sum(val) / count(DISTINCT "row") AS mean FROM w), df AS (SELECT "col" AS c, count(*) AS df FROM w GROUP BY 1)"""


@register("tfidf", f'WITH {_W} SELECT "row", "col", round(ln(val) * ln(n / df + 1), 6) AS val FROM w JOIN df ON c = "col", n')
def _(spark, d):
    return op.tfidf(_words(spark, d)).withColumn("val", F.round("val", 6))


@register("bm25", f"""WITH {_W}, ln AS (SELECT "row" AS r, sum(val) AS len FROM w GROUP BY 1)
SELECT "row", "col", round((1.6 + 1) * ln(val) / (1.6 * ((1 - 0.75) + 0.75 * len / mean) + ln(val)) * ln(n / df + 1), 6) AS val FROM w JOIN df ON c = "col" JOIN ln ON r = "row", n""")
def _(spark, d):
    return op.bm25(_words(spark, d)).withColumn("val", F.round("val", 6))


@register("sparse_select_k", f'WITH {OP}, r AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY val DESC, "col") AS rank FROM op) SELECT * FROM r WHERE rank <= 3')
def _(spark, d):
    from tessera.operators.dense import select_k_cells

    return select_k_cells(order_part(spark, d), 3, smallest=False).withColumn("rank", F.col("rank").cast("long"))


@register("spmm", f"""WITH {OP} SELECT "row", p_size::BIGINT AS "col", round(sum(val * p_retailprice), 2) AS val FROM op JOIN part ON p_partkey = "col" GROUP BY 1, 2""")
def _(spark, d):
    y = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").cast("long").alias("col"), F.col("p_retailprice").alias("val"))
    return op.spmm(order_part(spark, d), y).withColumn("val", F.round("val", 2))


_PAIRS = """m AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)
UNION SELECT vec_id, vec_id FROM embeddings)"""
_DOT = f"""WITH {E}, {_PAIRS} SELECT i AS "row", j AS "col", round(FACTOR, 6) AS val FROM m JOIN e x ON x."row" = i JOIN e y ON y."row" = j AND y."col" = x."col" GROUP BY 1, 2"""


def _pattern(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"))
    n = ids.agg(F.count("*").alias("n"))
    other = ids.join(F.broadcast(n)).select("row", ((F.col("row") * 7 + 3) % F.col("n")).alias("col"))
    return other.unionByName(ids.select("row", F.col("row").alias("col"))).distinct()


@register("sddmm", _DOT.replace("FACTOR", "2.0 * sum(x.val * y.val) + 0.5"))
def _(spark, d):
    rows = emb_rows(spark, d)
    return op.sddmm(_pattern(spark, d).withColumn("val", F.lit(1.0)), rows, rows.withColumnRenamed("row", "col"), 2.0, 0.5).withColumn("val", F.round("val", 6))


@register("masked_matmul", _DOT.replace("FACTOR", "sum(x.val * y.val)"))
def _(spark, d):
    rows = emb_rows(spark, d)
    return op.masked_matmul(_pattern(spark, d), rows, rows).withColumn("val", F.round("val", 6))


# the packed masks: 32 columns, one word for each row of the matrix, or one word for all rows
_COLS = "y AS (SELECT c.range AS j, k.range AS k, ((c.range * k.range) % 7)::DOUBLE AS v FROM range(32) c, range(64) k)"
_MASKED = f'WITH {E}, {_COLS} SELECT "row", j AS "col", round(sum(val * v), 6) AS val FROM e JOIN y ON k = "col" WHERE BIT = 1 GROUP BY 1, 2'


def _columns(spark):
    return spark.range(32).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ((F.col("id") * k) % 7).cast("double")).alias("vec"))


@register("masked_matmul_bitmap", _MASKED.replace("BIT", '(("row" * 2654435761) % 4294967296 >> j) & 1'))
def _(spark, d):
    rows = emb_rows(spark, d)
    words = rows.select(F.col("row").alias("at"), (F.col("row") * F.lit(2654435761) % F.lit(4294967296)).alias("word"))
    return op.masked_matmul(words, rows, _columns(spark), shape=(table(spark, d, "embeddings").count(), 32)).withColumn("val", F.round("val", 6))


@register("masked_matmul_bitset", _MASKED.replace("BIT", "(2863311530 >> j) & 1"))
def _(spark, d):
    words = spark.range(1).select(F.array(F.lit(2863311530)).alias("words"))
    return op.masked_matmul(words, emb_rows(spark, d), _columns(spark), shape=(0, 32)).withColumn("val", F.round("val", 6))


@register("symmetrize", f"""WITH {_NN}, s AS (SELECT a.*, b.val AS t FROM nn a LEFT JOIN nn b ON a."row" = b."col" AND a."col" = b."row")
SELECT "row", "col", round(val + coalesce(t, 0), 2) AS val FROM s UNION ALL SELECT "col", "row", round(val, 2) FROM s WHERE t IS NULL AND val <> 0""")
def _(spark, d):
    return op.symmetrize(_nation_cells(spark, d)).withColumn("val", F.round("val", 2))


@register("knn_symmetrize", f"""WITH {_NN} SELECT "row", "col", round(val, 2) AS val FROM nn UNION ALL SELECT "col", "row", round(val, 2) FROM nn""")
def _(spark, d):
    return op.knn_symmetrize(_nation_cells(spark, d).withColumn("val", F.round("val", 2)))
