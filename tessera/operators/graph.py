"""Graphs as edges ``(src, dst, w)`` or symmetric cells ``(row, col, val)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.sparse import add
from tessera.plans.scratch import spill
from tessera.plans.skew import skew_join


def laplacian(cells: DataFrame) -> DataFrame:
    """D - A without self-loops; D holds the sums of the remaining rows."""
    off = cells.where("row <> col").select("row", "col", F.col("val").cast("double").alias("val"))
    deg = off.groupBy("row").agg(F.sum("val").alias("val")).select("row", F.col("row").alias("col"), "val")
    return add(deg, off.select("row", "col", (-F.col("val")).alias("val")))


def normalized_laplacian(cells: DataFrame) -> DataFrame:
    """The Laplacian scaled by 1/sqrt(degree) on both sides with a unit diagonal; a degree of 0 counts as 1."""
    off = cells.where("row <> col")
    deg = off.groupBy("row").agg(F.sqrt(F.sum("val")).alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    scaled = off.join(deg, "row").join(deg.select(F.col("row").alias("col"), F.col("s").alias("t")), "col")
    return scaled.select("row", "col", (-F.col("val") / (F.col("s") * F.col("t"))).alias("val")).unionByName(deg.select("row", F.col("row").alias("col"), F.lit(1.0).alias("val")))


def weak_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, label)`` with label = smallest vertex of the component + 1.

    ``vertices`` ``(id, allowed)`` may shut vertices out: such a vertex passes no label on, but takes
    the smallest label among its allowed neighbours; without one its label is null.
    """
    if vertices is None:
        found = connected_components(edges)
        return found.select("id", (F.col("component") + 1).alias("label"))
    ok = vertices.where("allowed").select("id")
    both = edges.join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    inner = connected_components(both.select("src", "dst").unionByName(ok.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    around = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    shut = vertices.where("not allowed").select(F.col("id").alias("dst"))
    border = around.join(shut, "dst").join(inner.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("component"))
    all_ = inner.unionByName(shut.select(F.col("dst").alias("id")).join(border, "id", "left"))
    return all_.select("id", (F.col("component") + 1).alias("label"))


#: Edges up to which one task finishes a forest.
FEW_EDGES = 500_000


def _kruskal(batches):
    """The forest of few edges ``(src, dst, w, a, b)``, in the order that the rounds use."""
    import pyarrow as pa

    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    rows = list(zip(*(edges[c].to_pylist() for c in ("w", "src", "dst", "a", "b"))))
    root, keep = {}, []

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def place(i):  # null comes first and NaN last, as in Spark
        w = rows[i][0]
        return (w is not None, w != w, 0.0 if w is None or w != w else w, rows[i][1], rows[i][2])

    for i in sorted(range(len(rows)), key=place):
        a, b = find(rows[i][3]), find(rows[i][4])
        if a != b:
            root[a] = b
            keep.append(i)
    yield from edges.take(pa.array(keep, pa.int64())).combine_chunks().to_batches()


def minimum_spanning_forest(edges: DataFrame, symmetric: bool = False, max_rounds: int = 64) -> DataFrame:
    """Edges of a minimum spanning forest by Boruvka's rounds.

    Each component takes its lightest edge out, equal weights by the ends' order, so that no round
    closes a cycle; the number of components at least halves. A round is a grouped minimum and the
    components of the chosen edges; once at most ``FEW_EDGES`` are left, one task finishes, as further
    rounds would cost jobs and no work. ``symmetric`` gives each edge in both directions.
    """
    e = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))
    e = spill(e.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), "edges")
    chosen = None
    for _ in range(max_rounds):
        if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
            rest = spill(e.coalesce(1).mapInArrow(_kruskal, e.schema), "chosen")
            chosen = rest if chosen is None else chosen.unionByName(rest)
            break
        ends = e.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "src", "dst", "a", "b").alias("edge"))
        best = ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct()
        best = spill(best, "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
        comp = spill(connected_components(best, "a", "b"), "merged")
        moved = skew_join(e, comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), ["a"])
        moved = skew_join(moved, comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), ["b"]).where("ca <> cb")
        e = spill(moved.select("src", "dst", "w", F.col("ca").alias("a"), F.col("cb").alias("b")), "edges")
    else:
        raise RuntimeError(f"no forest after {max_rounds} rounds")
    out = chosen.select("src", "dst", "w")
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if symmetric else out


def _clustered(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    c = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("cs"))
    return edges.join(c, "src").join(c.select(F.col("src").alias("dst"), F.col("cs").alias("cd")), "dst")


def partition_quality(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(edge_cut, cost)`` of clusters ``(id, cluster)`` on undirected edges given once.

    The cut is the weight between clusters; the cost adds, for each cluster, the weight that leaves
    it over its size.
    """
    cross = _clustered(edges, clusters).where("cs <> cd")
    leaving = cross.select(F.explode(F.array("cs", "cd")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("out"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return leaving.join(sizes, "cluster").agg((F.coalesce(F.sum("out"), F.lit(0.0)) / 2).alias("edge_cut"), F.coalesce(F.sum(F.col("out") / F.col("n")), F.lit(0.0)).alias("cost"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sum over clusters of inner weight share minus the square of degree share, of undirected edges given once."""
    with_c = _clustered(edges, clusters)
    inner = with_c.where("cs = cd").groupBy(F.col("cs").alias("cluster")).agg(F.sum(2 * F.col("w")).alias("inside"))
    deg = with_c.select(F.explode(F.array("cs", "cd")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("deg"))
    total = deg.agg(F.sum("deg").alias("t"))
    per = deg.join(inner, "cluster", "left").join(F.broadcast(total))
    return per.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("t") - (F.col("deg") / F.col("t")) * (F.col("deg") / F.col("t"))).alias("v"))
