"""Jaccard join of documents' word n-gram sets in their metric space, to connected components.

Equal sets are one class; the distance of two classes is 1 - Jaccard, which is a metric, and classes
link at a distance of at most r = 1 - ``percent`` / 100. The join goes down in three steps, each
of which is exact, and in none is a group of similar documents ever expanded to pairs.

1. Voronoi regions. Pivots are documents: one of each of the most crowded min-hash cells, as far as
   they lie more than rho apart. The distance of every class to every pivot is computed exactly, by
   an inverted index of the pivots' n-grams. A class at most rho from its nearest pivot is *inside*
   that pivot's region. By the triangle inequality every partner of it is at most rho + r from the
   same pivot and at most 2 r further from it than from its own nearest pivot; the classes in this
   window are replicated to the region, so each link of an inside class is found in the region of its
   nearest pivot. The classes that are inside no region make the outer region, which holds all links
   between them. Links to a pivot itself are known by now and unite what lies around it.
2. Every region, the outer one included, splits into one cell for each n-gram: a class enters the
   cells of its first n - ceil(t n) + 1 n-grams in one fixed order, one of which it shares with each
   partner. Frequent n-grams come last in that order. Cells with the same classes, as those of a
   passage's n-grams, become one. Cells whose classes are all of one component are done. In the first
   cells of each class, the members are compared with one of them (a star).
3. Cells that still hold several components are joined inside a task, again by pivots: exact
   distances to a few members give windows that a linked pair cannot leave, sketches that bound the
   symmetric difference from below thin out what is left, and the rest is compared set by set, unless
   it is united by then. A task returns a spanning forest of the links, not the links.

Links of all steps together give the components: exactly those of all links. Sampled pivots alone do
not partition a corpus, as most documents are at a distance of 1 from any other; this is why the
second step is there (the README has figures).

N-grams are compared by 64-bit hashes (48 bits in the last step) and classes are numbered by 64-bit
hashes of their sets. The hashes mix every block of their input, but have no secret key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.embedding_dedup import _runs
from tessera.llm.words import LOWER, buffer_of, give_back, mix64, ragged, slices, window_hashes, word_edges, word_hashes
from tessera.operators.components import connected_components
from tessera.plans.batches import bound_batches
from tessera.plans.names import fresh
from tessera.plans.scratch import release, spill
from tessera.plans.skew import skew_join

LANES = 3  # min-hash cells a class, among which pivots are chosen
PIVOTS = 256  # at most
PIVOT_SIZE = 4096  # n-grams of a pivot at most, so that what is broadcast is bounded
EARLY = 8
INNER_PIVOTS = 8  # of a cell that a task joins
_BITS = 26  # of the filter that keeps sets that nobody asked for out of a shuffle
_MOST_FREQUENT = 1 << 17  # n-grams put last; bounds what is broadcast, not what is compared
_SALTS = mix64(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LATE, _EARLY, _LINK = 0, 1, 2
_FIRST = np.ones(1, bool)


def ngram_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each text's begin (one more than texts).

    A text with fewer than ``k`` words has its whole sequence as its one n-gram, one without words none.
    """
    buf, offs = buffer_of(texts)
    buf = LOWER[buf]
    s, e, first = word_edges(buf, offs)
    words = word_hashes(buf, s, e)
    h, at = window_hashes(words, first, k)
    begin = np.searchsorted(at, first)
    count = np.diff(first)
    out, edges = [], [0]
    for i, n in enumerate(count.tolist()):
        if n >= k:
            x = np.sort(h[begin[i] : begin[i + 1]])
            x = x[np.concatenate([_FIRST, x[1:] != x[:-1]])]
        elif n:
            x = np.array([n], np.uint64)
            for w in words[first[i] : first[i + 1]]:
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + mix64(np.array([w])))
        else:
            x = h[:0]
        out.append(x)
        edges.append(edges[-1] + len(x))
    return (np.concatenate(out) if out else h[:0]), np.array(edges)


def _level(n: np.ndarray) -> np.ndarray:
    """Logarithm of the number of parts for a set of n n-grams: two parts an n-gram, 256 at least."""
    return np.maximum(8, np.ceil(np.log2(np.maximum(n, 1) * 2.0))).astype(np.int64)


def parity_sketches(h: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Per set one bit for each part of the hash space: whether it holds an odd number of n-grams.

    Two sets' sketches differ in at most as many bits as the sets in n-grams.
    """
    n = np.diff(edges)
    level = _level(n)
    at = np.concatenate([[0], np.cumsum(1 << level)])
    doc = np.repeat(np.arange(len(n)), n)
    part = (h & ((np.uint64(1) << level[doc].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    odd = np.packbits((np.bincount(at[doc] + part, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[x >> 3 : y >> 3] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _class(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def pack_set(x: np.ndarray) -> bytes:
    """48 leading bits of each hash as differences of a fixed number of bytes."""
    x = np.unique(x >> np.uint64(16))
    gaps = np.diff(x, prepend=np.uint64(0))
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    wide = raw[0]
    n = (len(raw) - 1) // wide
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, 1).reshape(n, wide)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """One row per document, and rows that count n-grams which several documents of a slice share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, edges = ngram_sets(part.column(1), k)
                n = np.diff(edges)
                has = np.flatnonzero(n)
                cls = [_class(h[a:b]) if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
                lanes = np.zeros((len(n), LANES), np.uint64)
                if len(has):
                    lanes[has] = np.stack([np.minimum.reduceat(mix64(h ^ salt), edges[:-1][has]) for salt in _SALTS], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n),
                        pa.array(cls, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * LANES + 1, LANES, dtype=np.int32)), pa.array(lanes.ravel().view(np.int64))),
                        pa.array(parity_sketches(h, edges), pa.binary()),
                        pa.nulls(len(n), pa.int64()),
                    ],
                    ["doc_id", "n", "cls", "lanes", "sketch", "gram"],
                )
                u, times = np.unique(h, return_counts=True)
                often = times >= max(4, len(n) // 500)
                u, times = u[often].view(np.int64), times[often]
                m = len(u)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(times), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.array(u)], ["doc_id", "n", "cls", "lanes", "sketch", "gram"])

    return docs.mapInArrow(run, "doc_id long, n long, cls long, lanes array<long>, sketch binary, gram long")


class Pivots:
    """Sets of the pivots as an inverted index, and exact distances to them."""

    def __init__(self, sets: list[np.ndarray], classes: list[int], percent: int):
        self.r = 1 - percent / 100
        self.rho = min(2 * self.r, (1 - self.r) / 2)  # rho + r < 1: what shares no n-gram is beyond every window
        kept: list[int] = []
        for i, x in enumerate(sets):
            if all(1 - _jaccard(x, sets[j]) > self.rho for j in kept):
                kept.append(i)
        sets = [sets[i] for i in kept]
        self.classes = np.array([classes[i] for i in kept], np.int64)
        self.size = np.array([len(x) for x in sets], np.int64)
        self.percent = percent
        both = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(both, kind="stable")
        self.grams, self.at = np.unique(both[order], return_index=True)
        self.owner = owner[order]
        self.at = np.append(self.at, len(both))

    def places(self, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, pivot, distance, linked) of the pairs that share an n-gram, by set and distance."""
        if not len(self.grams) or not len(h):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0), np.zeros(0, bool)
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == h)
        at, doc = at[hit], np.searchsorted(edges, hit, side="right") - 1
        times = self.at[at + 1] - self.at[at]
        pair, shared = np.unique(np.repeat(doc, times) * len(self.size) + self.owner[ragged(self.at[at], times)], return_counts=True)
        doc, pivot = pair // len(self.size), pair % len(self.size)
        union = (edges[doc + 1] - edges[doc]) + self.size[pivot] - shared
        order = np.lexsort((pivot, 1 - shared / union, doc))
        return doc[order], pivot[order], (1 - shared / union)[order], (100 * shared >= self.percent * union)[order]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def _pivots(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> Pivots:
    """A document of each of the most crowded min-hash cells, at most ``PIVOTS`` of ``PIVOT_SIZE`` n-grams each."""
    cells = classes.where((F.col("n") <= PIVOT_SIZE) & F.col("least").isNotNull()).select("cls", "least", "n", F.posexplode("lanes").alias("lane", "cell"))
    member = F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "least"))
    some = cells.groupBy("lane", "cell").agg(F.count("*").alias("members"), member.alias("m")).where("members > 1").orderBy(F.desc("members"), "m.h", "lane").limit(PIVOTS)
    wanted = {r.m.cls: r.m.least for r in some.collect()}
    if not wanted:
        return Pivots([], [], percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, edges = ngram_sets(part.column(1), k)
                sets = [h[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                cls = [_class(x) for x in sets]
                own = [i for i, c in enumerate(cls) if c in wanted]  # an identifier may stand for other texts too
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["cls", "grams"])

    rows = docs.where(F.col("doc_id").isin(list(wanted.values()))).mapInArrow(run, "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams")).collect()
    found = {r.cls: np.frombuffer(bytes(r.grams), np.uint64) for r in rows}
    order = [c for c in wanted if c in found]  # by members
    return Pivots([found[c] for c in order], order, percent)


def _wanted(classes: DataFrame, column: str = "cls") -> np.ndarray:
    """A bit for each class asked for, by the low bits of its number: 8 MB however many there are."""
    x = F.pmod(F.col(column), F.lit(1 << _BITS)) + 1
    rows = classes.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _sets(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """``(cls, grams)`` of the classes whose bit is set, each once."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, edges = ngram_sets(part.column(1), k)
                cls, packed = {}, []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a:
                        c = _class(h[a:b])
                        low = c % (1 << _BITS)
                        if c not in cls and bits.value[low >> 3] >> (low & 7) & 1:
                            cls[c] = None
                            packed.append(pack_set(h[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(list(cls), pa.int64()), pa.array(packed, pa.binary())], ["cls", "grams"])

    return docs.mapInArrow(run, "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    sets = spill(_sets(docs, k, _wanted(ends)), "sets")
    both = skew_join(pairs, sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), ["b"])
    both = skew_join(both, sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), ["a"])

    def run(batches):
        for batch in batches:
            ok = []
            last, x = None, None
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, x = a, unpack_set(a)
                y = unpack_set(b)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int((x[at] == y).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_components(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows`` with the component of each class so far; a class without links is its own."""
    if parts is None:
        return rows.withColumn("component", F.col("cls"))
    return rows.join(parts.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def _sizes_fit(percent: int):
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_size.

    Documents link when their sets of ``k``-word n-grams (words of the text with A-Z lowered) have
    100 * |intersection| >= ``percent`` * |union|. ``component_id`` is the smallest identifier that
    links reach, null identifiers aside. Texts that are null or have no word link with nothing and
    are their own component, also among each other. An empty table gives no rows. ``docs`` is read
    several times and has to keep its rows, as a table does.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = spill(_described(source, k), "described")
    rows = made.where("gram is null").select("doc_id", "n", "cls")
    classes = made.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("lanes").alias("lanes"), F.first("sketch").alias("sketch"))
    classes = spill(classes, "classes")
    often = made.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(_MOST_FREQUENT)
    often = np.sort(np.array([r.gram for r in often.collect()], np.int64).view(np.uint64))
    members = spill(_cells(source, k, percent, often, _pivots(source, classes, k, percent)), "cells")
    links = members.where(F.col("kind") == _LINK).select(F.col("cell").alias("a"), F.col("cls").alias("b"))
    parts = spill(connected_components(links, "a", "b"), "components")
    cells = spill(members.where(F.col("kind") != _LINK).groupBy("cell", "cls").agg(F.max("kind").alias("kind")), "cells")

    # stars in the first cells of each class
    named = _with_components(cells.where(F.col("kind") == _EARLY).select("cell", "cls"), parts)
    named = named.join(classes.select("cls", "n"), "cls")
    centres = named.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "n", "component")).alias("c")).where("lo <> hi")
    centres = centres.select("cell", F.col("c.cls").alias("a"), F.col("c.n").alias("m"), F.col("c.component").alias("of"))
    stars = skew_join(named, centres, ["cell"]).where((F.col("component") != F.col("of")) & _sizes_fit(percent))
    stars = spill(stars.select("a", F.col("cls").alias("b")).distinct(), "stars")
    found = spill(_verified(source, stars, k, percent), "links")
    links = links.unionByName(found)
    before, parts = parts, spill(connected_components(links, "a", "b"), "components")
    release(before, stars)

    # what is left, cell by cell: the first cells again, then all
    for some in (cells.where(F.col("kind") == _EARLY), cells):
        named = _with_components(some.select("cell", "cls"), parts)
        open_ = named.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("cell")
        several = spill(skew_join(skew_join(named, open_, ["cell"]), classes.select("cls", "n"), ["cls"]).select("cell", "cls", "component", "n"), "several")
        mixed = spill(_partnered(several, classes, percent), "open")
        release(several)
        sets = spill(_sets(source, k, _wanted(mixed)), "sets")
        links = links.unionByName(spill(_joined(mixed, sets, percent), "links"))
        before, parts = parts, spill(connected_components(links, "a", "b"), "components")
        release(before, mixed, sets)
    release(members, cells)

    parts = parts.withColumnRenamed("id", "cls")
    marks = classes.select("cls", "least", "size").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = marks.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = skew_join(marks, least, ["component"]).select("cls", "component_id", "size")
    out = skew_join(rows, marks, ["cls"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"))


def _cells(docs: DataFrame, k: int, percent: int, often: np.ndarray, pivots: Pivots) -> DataFrame:
    """``(cell, cls, kind)``: the cells with two classes or more of all regions, and links to pivots.

    A cell is an n-gram in a region. Its kind is early if it is among the class's first ``EARLY``, or its
    first frequent ones; a link has the pivot's class in place of the cell. A task sends its
    entries as packed arrays by hash range, about 17 bytes each and each class once a slice; cells of
    one class end where a range's entries meet. There a cell gets its number from its classes, so that
    cells of the same classes are one; should different ones get the same number, their classes come
    together and no pair is lost. Rows repeat as far as such cells lie in several ranges.
    """
    spark = docs.sparkSession
    last, index = spark.sparkContext.broadcast(often), spark.sparkContext.broadcast(pivots)
    ranges = max(4, 2 * docs.rdd.getNumPartitions())

    def send(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, edges = ngram_sets(part.column(1), k)
                at = np.minimum(np.searchsorted(last.value, h), max(0, len(last.value) - 1))
                late = last.value[at] == h if len(last.value) else np.zeros(len(h), bool)
                doc, pivot, far, linked = index.value.places(h, edges)
                begin = np.searchsorted(doc, np.arange(len(edges)))
                salt = mix64(index.value.classes.view(np.uint64))
                seen, cells, owners, kinds = set(), [], [], []
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if a == b or (c := _class(h[a:b])) in seen:
                        continue
                    seen.add(c)
                    n = b - a
                    first = n - -(-percent * n // 100) + 1
                    rare = np.flatnonzero(~late[a:b])[:first]
                    pick = rare if len(rare) == first else np.concatenate([rare, np.flatnonzero(late[a:b])[: first - len(rare)]])
                    grams = h[a:b][pick]
                    nth = np.arange(first)
                    early = ((nth < EARLY) | ((nth >= len(rare)) & (nth < len(rare) + EARLY))).astype(np.int8)
                    p, q = begin[i], begin[i + 1]
                    if p == q or far[p] > index.value.rho:
                        cells.append(grams)
                        owners.append(np.full(first, c, np.int64))
                        kinds.append(early)
                    if p < q:
                        near = (far[p:q] <= index.value.rho + index.value.r + 1e-9) & (far[p:q] <= far[p] + 2 * index.value.r + 1e-9)
                        for x in pivot[p:q][near]:
                            cells.append(mix64(grams ^ salt[x]))
                            owners.append(np.full(first, c, np.int64))
                            kinds.append(early)
                        to = pivot[p:q][linked[p:q]]
                        to = to[index.value.classes[to] != c]
                        cells.append(index.value.classes[to].view(np.uint64))
                        owners.append(np.full(len(to), c, np.int64))
                        kinds.append(np.full(len(to), _LINK, np.int8))
                if not cells:
                    continue
                r, c, kind = np.concatenate(cells), np.concatenate(owners), np.concatenate(kinds)
                order = np.argsort(r)
                r, c, kind = r[order], c[order], kind[order]
                cuts = np.searchsorted(r, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges))
                for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(r)], strict=True)):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([r[a:b].tobytes()], pa.binary()), pa.array([c[a:b].tobytes()], pa.binary()), pa.array([kind[a:b].tobytes()], pa.binary())], ["hash_range", "cells", "owners", "kinds"])

    packs = docs.mapInArrow(send, "hash_range int, cells binary, owners binary, kinds binary").repartition(ranges, "hash_range").sortWithinPartitions("hash_range")

    def meet(batches):
        for group in _runs(batches, 1):
            r = np.frombuffer(b"".join(group["cells"].to_pylist()), np.int64)
            c = np.frombuffer(b"".join(group["owners"].to_pylist()), np.int64)
            kind = np.frombuffer(b"".join(group["kinds"].to_pylist()), np.int8)
            order = np.lexsort((kind, c, r))
            r, c, kind = r[order], c[order], kind[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            r, c, kind = r[new], c[new], kind[new]
            start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            size = np.diff(np.append(start, len(r)))
            number = np.add.reduceat(mix64(c.view(np.uint64)), start) if len(c) else start
            r = np.where(kind == _LINK, r, np.repeat(number.view(np.int64), size))
            many = np.repeat(size > 1, size) | (kind == _LINK)
            r, c, kind = r[many], c[many], kind[many]
            order = np.lexsort((-kind, c, r))
            r, c, kind = r[order], c[order], kind[order]
            new = np.concatenate([_FIRST, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])[: len(r)]
            r, c, kind = r[new], c[new], kind[new]
            for at in range(0, len(r), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 100_000]), pa.array(c[at : at + 100_000]), pa.array(kind[at : at + 100_000].astype(np.int32))], ["cell", "cls", "kind"])
        give_back()

    return packs.mapInArrow(meet, "cell long, cls long, kind int")


def _tiled(rows: DataFrame, most: int, most_grams: int) -> DataFrame:
    """``rows`` with ``i``, ``j`` and ``tile``, dealt out by (cell, i, j) and there sorted by size.

    A cell over ``most`` members or ``most_grams`` n-grams is cut into tiles, and each pair of tiles is a
    group of its own, so that a task holds two tiles at most.
    """
    size = rows.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / most_grams)).cast("int").alias("tiles"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, F.col("tile")).alias("i"), F.greatest(j, F.col("tile")).alias("j")))
    tiled = skew_join(rows, size, ["cell"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("at", F.explode(pairs))
    return tiled.select("cell", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "tile", *[c for c in rows.columns if c != "cell"])


def _groups(batches, most_rows: int, most_grams: int) -> Iterator[pa.Table]:
    """Whole groups by (cell, i, j), many small ones together."""
    held, n, grams = [], 0, 0
    for group in _runs(batches, 3):
        held.append(group)
        n += group.num_rows
        grams += int(np.asarray(group["n"].combine_chunks()).sum())
        if n >= most_rows or grams >= most_grams:
            yield pa.concat_tables(held)
            held, n, grams = [], 0, 0
    if held:
        yield pa.concat_tables(held)
    give_back()


def _partnered(several: DataFrame, classes: DataFrame, percent: int, most: int = 4096) -> DataFrame:
    """``(cell, cls, component, n)`` of the members that may link with one of another component in their cell, by sizes and sketches.

    Sketches join last, so that they are moved once.
    """
    rows = skew_join(_tiled(several, most, 1 << 40), classes.select("cls", "sketch"), ["cls"])
    columns = ["cell", "i", "j", "tile", "cls", "component", "n", "sketch"]
    dealt = rows.select(*columns).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "n")

    def run(batches):
        for rows in _groups(batches, 20_000, 1 << 40):
            keep = np.zeros(rows.num_rows, bool)
            n = np.asarray(rows["n"].combine_chunks()).astype(np.int64)
            level, blobs = _level(n), rows["sketch"].to_pylist()
            place, table = np.zeros(len(n), np.int64), {}
            for lv in np.unique(level):
                some = np.flatnonzero(level == lv)
                place[some] = np.arange(len(some))
                table[lv] = np.frombuffer(b"".join(blobs[k] for k in some), np.uint64).reshape(len(some), -1)
            for p, q in _pairs(rows, percent, lambda p, q: ~(keep[p] & keep[q])):
                near = _sketches_meet(p, q, n, level, place, table, percent)
                keep[p[near]] = keep[q[near]] = True
            yield from rows.filter(pa.array(keep)).select(["cell", "cls", "component", "n"]).to_batches()

    return dealt.mapInArrow(run, "cell long, cls long, component long, n long").distinct()


def _pairs(rows: pa.Table, percent: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group and different components whose sizes allow a link, as far as ``wanted`` still says so; groups are sorted by size."""
    cell, i, j, tile, comp, n = (np.asarray(rows[c].combine_chunks()).astype(np.int64) for c in ("cell", "i", "j", "tile", "component", "n"))
    group = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    scale = int(n.max()) * 100 // percent + 2
    end = np.searchsorted(group * scale + n, group * scale + n * 100 // percent, side="right")
    count = np.maximum(0, end - np.arange(len(n)) - 1)  # partners of a row: those after it that are not too large
    upto = np.cumsum(count)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000, side="right")))
        p = np.repeat(np.arange(at, to), count[at:to])
        q = ragged(np.arange(at, to) + 1, count[at:to])
        ok = (comp[p] != comp[q]) & (np.minimum(tile[p], tile[q]) == i[p]) & (np.maximum(tile[p], tile[q]) == j[p])
        p, q = p[ok], q[ok]
        ok = wanted(p, q)
        if ok.any():
            yield p[ok], q[ok]
        at = to


def _sketches_meet(p, q, n, level, place, table, percent) -> np.ndarray:
    """Whether the sketches of two sets allow the least intersection of a linked pair."""
    out = np.zeros(len(p), bool)
    total = n[p] + n[q]
    most = total - 2 * -(-percent * total // (100 + percent))  # of the symmetric difference
    for lp, lq in {(int(x), int(y)) for x, y in zip(*np.unique(np.stack([level[p], level[q]]), axis=1), strict=True)}:
        some = np.flatnonzero((level[p] == lp) & (level[q] == lq))
        step = max(1, (1 << 26) >> max(lp, lq))
        for k in range(0, len(some), step):
            r = some[k : k + step]
            x, y = table[lp][place[p[r]]], table[lq][place[q[r]]]
            # the halves of a sketch fold onto one of half as many parts
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[r] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[r]
    return out


def _joined(mixed: DataFrame, sets: DataFrame, percent: int, most: int = 2048, most_grams: int = 1 << 20) -> DataFrame:
    """A forest ``(a, b)`` of the links between different components of one cell, joined inside tasks."""
    rows = skew_join(_tiled(mixed, most, most_grams), sets, ["cls"])
    columns = ["cell", "i", "j", "tile", "cls", "component", "n", "grams"]
    dealt = rows.select(*columns).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "n", "cls")

    def run(batches):
        for held in _groups(batches, 20_000, 2 * most_grams):
            yield from _forest_of(held, percent)

    return dealt.mapInArrow(run, "a long, b long")


def _inner_distances(flat: np.ndarray, edges: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Distances of every member to ``INNER_PIVOTS`` members of its own group; of small groups none."""
    n = np.diff(edges)
    out = np.zeros((len(n), INNER_PIVOTS))
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(group)], strict=True):
        if b - a < 8 * INNER_PIVOTS:
            continue
        mine = flat[edges[a] : edges[b]]
        row = np.repeat(np.arange(b - a), n[a:b])
        nearest = np.full(b - a, 2.0)
        pick = a
        for k in range(INNER_PIVOTS):
            x = flat[edges[pick] : edges[pick + 1]]
            at = np.minimum(np.searchsorted(x, mine), len(x) - 1)
            shared = np.bincount(row[x[at] == mine], minlength=b - a)
            out[a:b, k] = 1 - shared / (n[a:b] + len(x) - shared)
            nearest = np.minimum(nearest, out[a:b, k])
            pick = a + int(nearest.argmax())  # the next one is far from those before
    return out


def _forest_of(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components of many whole groups, each sorted by size; as a forest."""
    cell, i, j, cls, comp = (np.asarray(rows[c].combine_chunks()).astype(np.int64) for c in ("cell", "i", "j", "cls", "component"))
    sets = [unpack_set(x) for x in rows["grams"].to_pylist()]
    size = np.array([len(x) for x in sets])
    flat, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    del sets
    group = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    far = _inner_distances(flat, edges, group)
    keys = (np.repeat(np.arange(len(size)), size).astype(np.uint64) << np.uint64(48)) | flat  # for probes of one row
    _, label = np.unique(comp, return_inverse=True)
    root = np.arange(int(label.max()) + 1)
    r = 1 - percent / 100 + 1e-9
    for p, q in _pairs(rows, percent, lambda p, q: root[label[p]] != root[label[q]]):
        for k in range(INNER_PIVOTS):  # the windows of the cell's own pivots
            ok = np.abs(far[p, k] - far[q, k]) <= r
            p, q = p[ok], q[ok]
        while len(p):
            some = max(1, int(np.searchsorted(np.cumsum(size[p]), 1_000_000)))
            x, y = p[:some], q[:some]
            probe = (np.repeat(y, size[x]).astype(np.uint64) << np.uint64(48)) | flat[ragged(edges[x], size[x])]
            found = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe
            shared = np.add.reduceat(found, np.cumsum(size[x]) - size[x], dtype=np.int64)
            link = 100 * shared >= percent * (size[x] + size[y] - shared)
            made = []
            for u, v in zip(x[link].tolist(), y[link].tolist(), strict=True):
                a, b = root[label[u]], root[label[v]]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    made.append((cls[u], cls[v]))
            if made:
                pair = np.array(made, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
            p, q = p[some:], q[some:]
            open_ = root[label[p]] != root[label[q]]
            p, q = p[open_], q[open_]


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest identifier; same columns.

    Documents with a null identifier stay. Rows that share an identifier stay or go together: they
    stay if one of them is its component's document.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select(F.struct("doc_id").alias(fresh("gone", docs.columns)))
    gone_id = F.col(f"{gone.columns[0]}.doc_id")
    return docs.join(gone, F.col(id_col).cast("long") == gone_id, "left_anti")
