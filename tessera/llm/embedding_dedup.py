"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a unit vector by three rounds of random signs and a Walsh-Hadamard transform and
takes the signed axis it lies nearest to; ``axes`` such hashes make a bucket. A vector is stored in
its own bucket of every table and probes the buckets in which one hash is replaced by the next
nearest axis. A bucket's vectors are compared in blocks of matrix products in double precision, so
no link has a cosine below the threshold, and no pair of a bucket is written out: a task sends
each vector's number of links and a spanning forest. A pair that meets in several places is counted
in the first one only, which the buckets that each vector carries along tell.

Equal vectors are one class with a multiplicity. Buckets over ``most`` rows are cut into tiles, and
every pair of tiles is a group of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import spill
from tessera.plans.skew import skew_join


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(x: np.ndarray, tables: int, axes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers of unit rows: shape (rows, tables, 1 + probes), the own bucket first."""
    n, dim = x.shape
    d = 1 << max(0, (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    rng = np.random.default_rng([seed, d])
    signs = rng.choice([-1.0, 1.0], size=(tables, axes, 3, d))
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        near, gap = [], []
        for a in range(axes):
            y = wide
            for r in range(3):
                y = hadamard(y * signs[t, a, r])
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, : min(d, 1 + probes)]
            top = np.take_along_axis(y, order, axis=1)
            near.append(2 * order + (top < 0))
            gap.append(np.abs(top[:, :1]) - np.abs(top))
        own = np.zeros(n, np.int64)
        for a in range(axes):
            own = own * (2 * d) + near[a][:, 0]
        out[:, t, 0] = own
        # single replacements, by how little they lose
        choices, loss = [], []
        for a in range(axes):
            unit_of = (2 * d) ** (axes - 1 - a)
            for j in range(1, near[a].shape[1]):
                choices.append(own + (near[a][:, j] - near[a][:, 0]) * unit_of)
                loss.append(gap[a][:, j])
        if choices:
            best = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")[:, :probes]
            got = np.take_along_axis(np.stack(choices, axis=1), best, axis=1)
            out[:, t, 1 : 1 + got.shape[1]] = got
            out[:, t, 1 + got.shape[1] :] = own[:, None]
        else:
            out[:, t, 1:] = own[:, None]
    return out


def _classes(vectors: DataFrame, kind: type) -> DataFrame:
    """``(vec_id, cls, vec)``: the class is a digest of the components; null for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vec = [], []
            for v in batch.column(1):
                values = v.values
                good = values is not None and len(values) and not values.null_count
                x = np.asarray(values).astype(kind) + kind(0) if good else None  # one zero, not two
                if x is None or not np.isfinite(x).all() or not x.any():
                    cls.append(None)
                    vec.append(None)
                else:
                    raw = x.tobytes()
                    cls.append(hashlib.blake2b(raw, digest_size=16).digest())
                    vec.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "cls", "vec"])

    return vectors.mapInArrow(run, "vec_id long, cls binary, vec binary")


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    tables: int | None = None,
    axes: int | None = None,
    probes: int = 2,
    most: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Pairs with a cosine of ``threshold`` or more are linked as far as they meet in a bucket; none
    below is. Vectors of different lengths never link, nor do null and zero vectors and those with a
    null or non-finite component: they have no links and are their own component. Equal vectors
    always link. ``axes`` grows with the logarithm of the number of vectors, so that buckets stay
    small, and ``tables`` with it, so that the recall stays. An empty table gives no rows.
    """
    kind = np.float64 if vectors.schema[vec_col].dataType.elementType.typeName() == "double" else np.float32
    rows = spill(_classes(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), kind), "vectors")
    valid = rows.where("cls is not null")
    classes = valid.groupBy("cls").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    classes = spill(classes, "classes")
    n = classes.count()
    axes = axes or max(2, math.ceil(math.log(max(n, 2) / 64, 128)))
    tables = tables or 3 + 3 * (axes - 1)
    per = 1 + probes

    def locate(batches):
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            width = np.array([len(b) for b in blobs])
            for w in np.unique(width):
                some = np.flatnonzero(width == w)
                x = np.frombuffer(b"".join(blobs[i] for i in some), kind).reshape(len(some), -1)
                flat = [r.astype("<i8").tobytes() for r in buckets(unit(x), tables, axes, probes, seed).reshape(len(some), -1)]
                kept = [batch.column(i).take(pa.array(some)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w, np.int32)), *kept, pa.array(flat, pa.binary())], ["width", "cls", "mult", "vec", "places"])

    located = spill(classes.select("cls", "mult", "vec").mapInArrow(locate, "width int, cls binary, mult long, vec binary, places binary"), "places")
    key = ["width", "tbl", "bucket"]

    def spread(batches):
        """Each row in all of its places; ``places`` is the last column."""
        for batch in batches:
            b = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), "<i8").reshape(batch.num_rows, tables, per)
            for t in range(tables):
                for p in range(per):
                    fresh = np.ones(len(b), bool) if p == 0 else ~(b[:, t, p : p + 1] == b[:, t, :p]).any(axis=1)
                    k = pa.array(np.flatnonzero(fresh))
                    n = len(k)
                    rest = [batch.column(i).take(k) for i in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(k), pa.array(np.full(n, t, np.int32)), pa.array(b[fresh, t, p]), pa.array(np.full(n, p == 0)), *rest], [*key, "own", *batch.schema.names[1:]])

    place = "width int, tbl int, bucket long, own boolean"
    counted = located.select("width", "places").mapInArrow(spread, f"{place}, places binary").groupBy(*key).agg(F.count("*").alias("n"))
    # few buckets are over the bound, so that the join needs no exchange of the vectors unless they are many
    large = spill(counted.where(F.col("n") > most).select(*key, F.ceil(F.col("n") / most).cast("int").alias("tiles")), "buckets")
    placed = located.select("width", "cls", "mult", "vec", "places").mapInArrow(spread, f"{place}, cls binary, mult long, vec binary, places binary")
    placed = placed.join(large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, F.col("tile")).alias("i"), F.greatest(j, F.col("tile")).alias("j")))
    placed = placed.withColumn("tile", tile).withColumn("at", F.explode(pairs)).withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).drop("at", "tiles")
    order = [*key, "i", "j"]
    dealt = placed.repartition(*order).sortWithinPartitions(*order)

    def link(batches):
        for group in _runs(batches, 5):
            yield from _linked(group, threshold, kind, tables, per)

    linked = spill(dealt.select(*order, "own", "tile", "cls", "mult", "vec", "places").mapInArrow(link, "cls binary, links long, other binary"), "links")
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(linked.where("other is not null"), "cls", "other").withColumnRenamed("id", "cls")
    marks = classes.select("cls", "mult", "least").join(counts, "cls", "left").join(joined, "cls", "left")
    marks = marks.withColumn("component", F.coalesce("component", "cls"))
    least = marks.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = skew_join(marks, least, ["component"]).select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = skew_join(rows.select("vec_id", "cls"), marks, ["cls"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _runs(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """Rows that come sorted by their first ``n_key`` columns, one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(n_key)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _linked(group: pa.Table, threshold: float, kind: type, tables: int, per: int) -> Iterator[pa.RecordBatch]:
    """Links of one bucket (or pair of tiles): per vector the multiplicities of its partners, and a forest."""
    n = group.num_rows
    own = np.asarray(group["own"].combine_chunks())
    if n < 2 or not own.any():
        return
    tbl, bucket = int(group["tbl"][0].as_py()), int(group["bucket"][0].as_py())
    i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
    tile = np.asarray(group["tile"].combine_chunks())
    x = unit(np.frombuffer(b"".join(group["vec"].to_pylist()), kind).reshape(n, -1))
    places = np.frombuffer(b"".join(group["places"].to_pylist()), "<i8").reshape(n, tables, per)
    cls = group["cls"].to_pylist()
    rank = np.empty(n, np.int64)
    rank[np.array(sorted(range(n), key=cls.__getitem__))] = np.arange(n)
    mult = np.asarray(group["mult"].combine_chunks()).astype(np.int64)
    links, label = np.zeros(n, np.int64), np.arange(n)
    stored = np.flatnonzero(own)
    block = max(16, 4_000_000 // n)
    for at in range(0, len(stored), block):
        some = stored[at : at + block]
        a, b = np.nonzero(x[some] @ x.T >= threshold)
        a = some[a]
        # two stored vectors meet twice; a pair belongs to the group of its own two tiles
        ok = (a != b) & (~own[b] | (rank[a] < rank[b])) & (np.minimum(tile[a], tile[b]) == i) & (np.maximum(tile[a], tile[b]) == j)
        a, b = a[ok], b[ok]
        for k in range(0, len(a), 200_000):
            p, q = a[k : k + 200_000], b[k : k + 200_000]
            first = _first_place(places[p], places[q], rank[p] < rank[q], tbl, bucket)
            p, q = p[first], q[first]
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            _join(label, p, q)
    some = np.flatnonzero(links)
    if len(some):
        root = label.copy()
        while (root[root] != root).any():
            root = root[root]
        other = [cls[root[k]] if root[k] != k else None for k in some]
        yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in some], pa.binary()), pa.array(links[some]), pa.array(other, pa.binary())], ["cls", "links", "other"])


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Unite the ends of all pairs; labels fall until they no longer change."""
    while len(p):
        a, b = label[p], label[q]
        open_ = a != b
        if not open_.any():
            return
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _first_place(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, tbl: int, bucket: int) -> np.ndarray:
    """Whether (tbl, bucket) is the first place in which each pair meets."""
    a_in_b = (a[:, :, :1] == b).any(axis=2)  # a's own bucket is one that b stands in
    b_in_a = (b[:, :, :1] == a).any(axis=2)
    meet = a_in_b | b_in_a
    t = meet.argmax(axis=1)
    rows = np.arange(len(a))
    at_a, at_b = a_in_b[rows, t], b_in_a[rows, t]
    own_a, own_b = a[rows, t, 0], b[rows, t, 0]
    where = np.where(at_a & (a_first | ~at_b), own_a, own_b)
    return (t == tbl) & (where == bucket)
