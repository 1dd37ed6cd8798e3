"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition is one run of digests. In each round the runs of ``fan_in`` neighbouring
numbers meet: their entries are dealt out by (new run number, digest), merged in digest order, and
of each digest one entry remains with the best identifier and the sum of the counts. The rounds end
when a single run is left, which lies dealt out by digest over all tasks. A digest that fills a
third of all rows is down to one entry a run before the first exchange. Spark plans a round as a sort
of each run by digest, a merge of equal neighbours, an exchange, and the same on what meets.

An entry's key is the SHA-256 digest with the byte length and a second, independent 64-bit hash of
the text, so that an entry is merged only where all three agree. That is what verifies it: texts
themselves are not moved, as two that agree in all three are not known to exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.names import fresh
from tessera.plans.scratch import spill
from tessera.plans.skew import skew_join

_KEY = ["__sha", "__len", "__xx"]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 16
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the
    largest (``keep="largest"``) or smallest identifier stays; null identifiers lose against any
    other, and of rows with the same text and identifier exactly one stays. An empty table gives
    no rows; further columns, whatever their names, are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("__sha"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(text).alias("__xx"),
        F.monotonically_increasing_id().alias("__row"),
        F.spark_partition_id().alias("__run"),
    )
    rows = spill(rows, "digests")
    final = merge_runs(rows, keep, fan_in)
    copies = final.where("n > 1").select(*_KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.__row").alias("keep_row"), F.col("n").alias("group_size"))
    out = skew_join(rows, copies, _KEY, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("__row"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def merge_runs(rows: DataFrame, keep: str, fan_in: int) -> DataFrame:
    """``(key, best, n)``: one entry per digest after the last round."""
    order = F.col("doc_id")
    entry = F.struct(F.coalesce(order.isNotNull(), F.lit(False)).alias("known"), order.alias("doc_id"), (-F.col("__row")).alias("first"), F.col("__row"))
    if keep == "smallest":
        entry = F.struct(order.isNull().alias("unknown"), order.alias("doc_id"), F.col("__row").alias("first"), F.col("__row"))
    best = F.max if keep == "largest" else F.min
    runs = (rows.agg(F.max("__run")).first()[0] or 0) + 1
    now = rows.select("__run", *_KEY, entry.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        runs = -(-runs // fan_in)
        now = (
            now.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int"))
            .groupBy("__run", *_KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        if runs == 1:
            return now.drop("__run")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """``docs`` with one row for each distinct text, chosen as by :func:`exact_duplicates`; same columns.

    Of rows with the same text and identifier the one with the least hash of all its columns stays.
    A null text counts as empty, null identifiers as one identifier; an empty table gives no rows.
    """
    columns = docs.columns
    ident, sha, nth = (fresh(c, columns) for c in ("ident", "sha", "nth"))
    kept = exact_duplicates(docs, id_col, text_col, keep, fan_in).where("kept")
    kept = kept.select(_name("doc_id").alias(ident), F.unhex("text_sha256").alias(sha))
    keyed = docs.withColumns({ident: _name(f"`{id_col}`"), sha: F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))})
    # rows of one text and identifier shrink to one a task before they move
    first = Window.partitionBy(ident, sha).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    alone = keyed.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return alone.join(kept, [ident, sha], "left_semi").select(*[f"`{c}`" for c in columns])


def _name(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("null"))
