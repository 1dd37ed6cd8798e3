"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.names import fresh

_SALT = 0x5DEECE66D


def spread_key(*cols: Column) -> Column:
    """A join key no earlier partitioning matches.

    Adaptive execution splits a hot partition only where both sides of a sort-merge join come
    straight from exchanges of the join's own. Keys hashed anew bring that about even when one
    side was already dealt out by the same columns, as after an aggregation.
    """
    return F.xxhash64(F.lit(_SALT), *cols)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, of which hot ones are split at run time. Null keys never match."""
    k = fresh("spread", [*left.columns, *right.columns])
    a = left.withColumn(k, F.when(_known(keys), spread_key(*map(F.col, keys))))
    b = right.withColumn(k, F.when(_known(keys), spread_key(*map(F.col, keys))))
    return a.join(b, [k, *keys], how).drop(k)


def _known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out
