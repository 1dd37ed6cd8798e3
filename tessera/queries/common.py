"""The matrices, vectors and graphs that the queries make of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def emb_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))


def emb_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("long").alias("key"))


#: embeddings as cells
E = """e AS (SELECT vec_id AS "row", unnest(range(len(embedding))) AS "col", unnest(embedding)::DOUBLE AS val FROM embeddings)"""


def order_part(spark: SparkSession, d: str) -> DataFrame:
    """Sparse matrix: orders by parts, summed quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


OP = """op AS (SELECT l_orderkey AS "row", l_partkey AS "col", sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"""


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """Graph: customers of one nation joined in a ring by key, and to the nation's least customer, weighted by balance."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    from pyspark.sql import Window

    w = Window.partitionBy("n").orderBy("k")
    e = c.select("k", F.lag("k").over(w).alias("p"), F.round(F.abs("b") + 1, 2).alias("w"), F.row_number().over(w).alias("i"), F.first("k").over(w).alias("f"))
    ring = e.where("p is not null").select(F.col("p").alias("src"), F.col("k").alias("dst"), "w")
    hub = e.where("i > 2 and i % 3 = 0").select(F.col("f").alias("src"), F.col("k").alias("dst"), (F.col("w") * 2).alias("w"))
    return ring.unionByName(hub)


G = """c AS (SELECT c_custkey AS k, lag(c_custkey) OVER w AS p, round(abs(c_acctbal) + 1, 2) AS wt, row_number() OVER w AS i, first_value(c_custkey) OVER w AS f
      FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
g AS (SELECT p AS src, k AS dst, wt AS w FROM c WHERE p IS NOT NULL UNION ALL SELECT f, k, wt * 2 FROM c WHERE i > 2 AND i % 3 = 0)"""
