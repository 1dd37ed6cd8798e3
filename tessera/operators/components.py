"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import release, spill
from tessera.plans.skew import skew_join


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; the component is its smallest vertex.

    Each task first reduces its batches of integer edges to forests of stars. Then large-star and
    small-star steps alternate: each hangs neighbours below the smallest vertex they see, so that
    every component becomes a star in a logarithmic number of rounds. A step is a grouped minimum
    and a join; the hub of a star is a hot key of that join only, which ``skew_join`` splits. Each
    step is written to the shared folder.

    Self-loops give a vertex of its own; edges with a null end are left out; no edges, no rows.
    Any orderable vertex type will do.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    if dict(pairs.dtypes) == {"u": "bigint", "v": "bigint"}:
        pairs = pairs.mapInArrow(_forests, pairs.schema)
    now = spill(_down(pairs), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = skew_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = spill(_down(large), "edges")
        before, mark = mark, _mark(large)
        release(now)
        now = large
        least = spill(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        if (least.agg(F.max("n")).first()[0] or 1) == 1:  # stars already: a small-star step would change nothing
            release(least)
            if mark == before:
                break
            continue
        small = skew_join(large, least.drop("n"), ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = spill(_down(small.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        release(large, least)
        mark = _mark(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).unionByName(loops)
    return found.groupBy("id").agg(F.min("component").alias("component"))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components inside each batch, as stars around their smallest vertices."""
    for batch in batches:
        ids, ends = np.unique(np.concatenate([np.asarray(batch.column(0)), np.asarray(batch.column(1))]), return_inverse=True)
        p, q = ends[: batch.num_rows], ends[batch.num_rows :]
        label = np.arange(len(ids))
        while len(p):
            a, b = label[p], label[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["u", "v"])


def _down(pairs: DataFrame) -> DataFrame:
    """Each pair once, the larger vertex first."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and a sum of hashes: two rounds with the same mark have the same edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
