"""Collective operations over ranks.

A rank is a value of the column ``rank``; what a rank holds are its rows. Reductions are grouped
aggregates, so that partial results come before any exchange. What every rank receives is written
once for each, as the operation says; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW: dict[str, Callable[[str], Column]] = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}


def ranks(held: DataFrame) -> DataFrame:
    """``(rank)`` of all ranks that hold anything."""
    return held.select("rank").distinct()


def reduce(held: DataFrame, how: str = "sum", root: int = 0) -> DataFrame:
    """``(rank, i, v)`` of the root: the values at each place ``i`` of all ranks, brought together."""
    return held.groupBy("i").agg(HOW[how]("v").alias("v")).select(F.lit(root).cast("long").alias("rank"), "i", "v")


def allreduce(held: DataFrame, how: str = "sum") -> DataFrame:
    """``(rank, i, v)``: every rank has what :func:`reduce` gives its root."""
    return ranks(held).crossJoin(reduce(held, how).select("i", "v"))


def bcast(held: DataFrame, root: int = 0) -> DataFrame:
    """``(rank, i, v)``: every rank has the root's values."""
    return ranks(held).crossJoin(held.where(F.col("rank") == root).select("i", "v"))


def _placed(held: DataFrame) -> DataFrame:
    """Each value with its place among all ranks' values, by rank and then ``i``; ranks may hold different numbers.

    Only the counts, one a rank, are added up in order.
    """
    from pyspark.sql import Window

    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("rank").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return held.join(counts.select("rank", "start"), "rank").select((F.col("start") + F.col("i")).alias("i"), "v")


def gather(held: DataFrame, root: int = 0) -> DataFrame:
    """``(rank, i, v)`` of the root: the values of all ranks, one after another (gather and gatherv)."""
    return _placed(held).select(F.lit(root).cast("long").alias("rank"), "i", "v")


def allgather(held: DataFrame) -> DataFrame:
    """``(rank, i, v)``: every rank has the values of all (allgather and allgatherv)."""
    return ranks(held).crossJoin(_placed(held))


def reducescatter(held: DataFrame, n: int, how: str = "sum") -> DataFrame:
    """``(rank, i, v)``: of the reduced values each of the ranks 0, 1, ... gets ``n`` in a row, numbered from 0."""
    out = reduce(held, how)
    return out.select(F.floor(F.col("i") / n).alias("rank"), (F.col("i") % n).alias("i"), "v")


def barrier(held: DataFrame) -> int:
    """Waits until every rank's rows are computed; returns the number of ranks."""
    return ranks(held).count()
