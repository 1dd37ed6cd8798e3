"""Labels and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components


def unique_labels(labels: DataFrame) -> DataFrame:
    """Distinct labels ``(label)`` of ``(i, label)``."""
    return labels.select("label").distinct()


def one_vs_rest(labels: DataFrame, label: int) -> DataFrame:
    return labels.select("i", F.when(F.col("label") == label, 1).otherwise(-1).alias("label"))


def make_monotonic(labels: DataFrame, zero_based: bool = False, keep=None) -> DataFrame:
    """Labels renumbered 1, 2, ... in their order; those that ``keep`` (a predicate) accepts stay as they are.

    The distinct labels are numbered, not the rows, so the ordering window holds one row a class.
    """
    start = 0 if zero_based else 1
    order = Window.orderBy("label")
    classes = unique_labels(labels)
    if keep is not None:
        classes = classes.where(~keep(F.col("label")))
    numbered = classes.select("label", (F.row_number().over(order) - 1 + start).alias("__new"))
    return labels.join(numbered, "label", "left").select("i", F.coalesce("__new", "label").cast("long").alias("label"))


def merge_labels(df: DataFrame, unlabelled: int = 2**31 - 1) -> DataFrame:
    """Two labelings of the same points ``(i, a, b, mask)`` merged: where the mask is true, labels a and b are one class.

    A merged class has the least of its labels; an unlabelled side says nothing.
    """
    known_a, known_b = F.col("a") != unlabelled, F.col("b") != unlabelled
    edges = df.where(F.col("mask") & known_a & known_b).select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")).distinct()
    roots = connected_components(edges).select(F.col("id").alias("__id"), "component")
    out = df.withColumn("__l", F.when(known_a, F.col("a")).otherwise(F.when(known_b, F.col("b")).otherwise(F.lit(unlabelled))).cast("long"))
    return out.join(roots, F.col("__l") == F.col("__id"), "left").select("i", F.coalesce("component", "__l").alias("label"))


def _hungarian(cost):
    """Least-cost assignment of a square matrix by shortest augmenting paths, columns scanned as arrays."""
    import numpy as np

    n = len(cost)
    u, v, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for row in range(n):
        dist, parent, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        i, low, column = row, 0.0, -1
        while True:
            reach = low + cost[i] - u[i] - v
            better = ~done & (reach < dist)
            dist[better], parent[better] = reach[better], i
            column = int(np.where(done, np.inf, dist).argmin())
            low = dist[column]
            done[column] = True
            if owner[column] < 0:
                break
            i = owner[column]
        u[row] += low
        seen = np.flatnonzero(done & (owner >= 0))
        u[owner[seen]] += low - dist[seen]
        v[done] -= low - dist[done]
        while column >= 0:
            i = parent[column]
            previous = np.flatnonzero(owner == i)
            owner[column] = i
            column = int(previous[0]) if i != row and len(previous) else -1
    return owner


def linear_assignment(costs: DataFrame) -> DataFrame:
    """Least-cost one-to-one assignment of each batch of square matrices ``(batch, row, col, cost)``.

    Batches are independent groups; one matrix is in one task.
    """
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.row.max()) + 1
        cost = np.zeros((n, n))
        cost[pdf.row, pdf.col] = pdf.cost
        owner = _hungarian(cost)
        return pd.DataFrame({"batch": int(pdf.batch.iloc[0]), "row": owner, "col": np.arange(n), "cost": cost[owner, np.arange(n)]}).sort_values("row")

    return costs.groupBy("batch").applyInPandas(solve, "batch long, row long, col long, cost double")
