"""Statistics of columns, regression and classification metrics, clustering metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.elementwise import divide_check_zero
from tessera.plans.scratch import spill

# summary


def column_means(cells: DataFrame, sample: bool = False) -> DataFrame:
    """Mean per column; ``sample`` divides by one less."""
    n = F.count("*") - 1 if sample else F.count("*")
    return cells.groupBy(F.col("col").alias("i")).agg((F.sum("val") / n).alias("v"))


def column_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("col").alias("i")).agg(F.sum("val").alias("v"))


def variances(cells: DataFrame, mu: DataFrame, sample: bool = True, root: bool = False) -> DataFrame:
    """Mean squared distance to the given means ``(i, v)`` per column, or its root."""
    d = F.col("val") - F.col("__mu")
    n = F.greatest(F.lit(1), F.count("*") - 1) if sample else F.count("*")
    out = F.sum(d * d) / n
    return cells.join(mu.select(F.col("i").alias("col"), F.col("v").alias("__mu")), "col").groupBy(F.col("col").alias("i")).agg((F.sqrt(out) if root else out).alias("v"))


def mean_var(cells: DataFrame, sample: bool = True) -> DataFrame:
    """Mean and variance per column in one pass; the variance of one row is 0."""
    var = F.coalesce(F.var_samp("val"), F.lit(0.0)) if sample else F.var_pop("val")
    return cells.groupBy(F.col("col").alias("i")).agg(F.avg("val").alias("mean"), var.alias("var"))


def covariance(rows: DataFrame, sample: bool = True) -> DataFrame:
    """``(row, col, val)`` of the covariance matrix.

    Each task sums outer products of its rows into one D x D array (see linalg.gram), so the
    shuffle holds D*D values a task, not D*D values a row.
    """
    from tessera.operators.linalg import gram_cells

    return gram_cells(rows, centred=True, divisor=lambda n: max(1, n - 1) if sample else n)


def mean_center(cells: DataFrame, add: bool = False) -> DataFrame:
    mu = column_means(cells).select(F.col("i").alias("col"), F.col("v").alias("__mu"))
    return cells.join(mu, "col").select("row", "col", (F.col("val") + F.col("__mu") if add else F.col("val") - F.col("__mu")).alias("val"))


def min_max(cells: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Least and greatest value per column, NaN skipped; of the given ``rows`` ``(row)`` and ``cols`` ``(col)`` only, if there are any."""
    if rows is not None:
        cells = cells.join(rows.select("row").distinct(), "row", "left_semi")
    if cols is not None:
        cells = cells.join(cols.select("col").distinct(), "col", "left_semi")
    v = F.when(~F.isnan("val"), F.col("val"))
    return cells.groupBy(F.col("col").alias("i")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def weighted_mean(cells: DataFrame, weights: DataFrame, along: str = "row") -> DataFrame:
    """Per row (or column), the mean weighted by ``(i, w)`` over the other axis."""
    other = "col" if along == "row" else "row"
    return cells.join(weights.select(F.col("i").alias(other), "w"), other).groupBy(F.col(along).alias("i")).agg((F.sum(F.col("val") * F.col("w")) / F.sum("w")).alias("v"))


def histogram(cells: DataFrame, n_bins: int, binner: Callable[[Column, Column, Column], Column] = lambda v, r, c: v.cast("int")) -> DataFrame:
    """Counts per column and bin, empty bins included."""
    spark = cells.sparkSession
    counts = cells.groupBy("col", binner(F.col("val"), F.col("row"), F.col("col")).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = F.broadcast(spark.range(n_bins).select(F.col("id").alias("bin")))
    return cells.select("col").distinct().join(bins).join(counts, ["col", "bin"], "left").select("col", "bin", F.coalesce("n", F.lit(0)).alias("n"))


# predictions ``(i, y, y_hat)``


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.when(F.col("y") == F.col("y_hat"), 1.0).otherwise(0.0)).alias("v"))


def r2_score(df: DataFrame) -> DataFrame:
    """1 - SSE / SST; the mean is found first."""
    mean = F.broadcast(df.agg(F.avg("y").alias("__m")))
    e, t = F.col("y") - F.col("y_hat"), F.col("y") - F.col("__m")
    return df.join(mean).agg((1 - F.sum(e * e) / F.sum(t * t)).alias("v"))


def regression_metrics(df: DataFrame) -> DataFrame:
    e = F.col("y") - F.col("y_hat")
    median = exact_median(df.select(F.abs(e).alias("v")))
    return df.agg(F.avg(F.abs(e)).alias("mean_abs"), F.avg(e * e).alias("mean_sq")).select("mean_abs", "mean_sq", F.lit(median).alias("median_abs"))


def exact_median(values: DataFrame, most: int = 100_000) -> float | None:
    """Median of ``v``, the mean of the middle two of an even number; null and NaN are skipped, of none it is None.

    A bracket around the middle ranks is narrowed by approximate quantiles and exact counts until at
    most ``most`` values, or a single one many times over, lie in it; only those are sorted.
    """
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if not n:
        return None
    low, high = (float(x) for x in values.agg(F.min("v"), F.max("v")).first())
    ranks = ((n - 1) // 2, n // 2)

    def at(rank: int, low: float, high: float) -> float:
        below = 0
        while True:
            inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
            m = inside.count()
            below = values.where(F.col("v") < low).count()
            if low == high:
                return low
            if m <= most:
                return float(inside.orderBy("v").limit(rank - below + 1).agg(F.max("v")).first()[0])
            share = (rank - below) / m
            a, b = inside.agg(F.percentile_approx("v", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)).first()[0]
            a, b = float(a), float(b)
            if values.where(F.col("v") < a).count() > rank:
                a, b = low, a
            elif values.where(F.col("v") <= b).count() <= rank:
                a, b = b, high
            if (a, b) == (low, high):  # a few values fill the bracket: take the middle one or step past it
                a = b = float(inside.agg(F.percentile_approx("v", share, 10_000)).first()[0])
                if values.where(F.col("v") < a).count() > rank:
                    a, b = low, float(values.where(F.col("v") < a).agg(F.max("v")).first()[0])
                elif values.where(F.col("v") <= b).count() <= rank:
                    a, b = float(values.where(F.col("v") > b).agg(F.min("v")).first()[0]), high
            low, high = a, b

    first = at(ranks[0], low, high)
    return first if ranks[0] == ranks[1] else (first + at(ranks[1], first, high)) / 2


def information_criterion(df: DataFrame, kind: str, n_params: int, n_samples: int) -> DataFrame:
    """AIC, AICc or BIC of log-likelihoods ``(i, loglike)``."""
    n, t = n_params, n_samples
    base = {"AIC": 2.0 * n, "AICc": 2.0 * (n + n * (n + 1) / (t - n - 1)), "BIC": math.log(t) * n}[kind]
    return df.select("i", (F.lit(base) - 2.0 * F.col("loglike")).alias("v"))


# labelings ``(truth, pred)``


def contingency(df: DataFrame) -> DataFrame:
    return df.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def contingency_matrix(df: DataFrame, spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """The square matrix over labels lo to hi, zeros included, numbered from 0."""
    from tessera.operators.dense import dense_grid

    cells = contingency(df).select((F.col("truth") - lo).cast("long").alias("truth"), (F.col("pred") - lo).cast("long").alias("pred"), F.col("n").cast("double").alias("val"))
    return dense_grid(cells, spark, "truth", hi - lo + 1, "pred", hi - lo + 1).select("truth", "pred", F.col("val").cast("long").alias("n"))


def label_scores(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """All scores that follow from the contingency counts, in one row.

    Columns: entropy_truth, entropy_pred, mutual_info, homogeneity, completeness, v_measure, rand_index, adjusted_rand.
    The rows are grouped once; everything after works on counts of label pairs.
    """
    cells = contingency(df)
    by_t, by_p = Window.partitionBy("truth"), Window.partitionBy("pred")
    c = cells.withColumn("a", F.sum("n").over(by_t)).withColumn("b", F.sum("n").over(by_p))
    c = c.withColumn("first_t", F.row_number().over(by_t.orderBy("pred")) == 1).withColumn("first_p", F.row_number().over(by_p.orderBy("truth")) == 1)
    pairs = lambda x: x.cast("double") * (x - 1) / 2
    s = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.when(F.col("first_t"), F.col("a") * F.ln("a"))).alias("ala"),
        F.sum(F.when(F.col("first_p"), F.col("b") * F.ln("b"))).alias("blb"),
        F.sum(F.col("n") * (F.ln("n") - F.ln(F.col("a").cast("double") * F.col("b")))).alias("mi"),
        F.sum(pairs(F.col("n"))).alias("both"),
        F.sum(F.when(F.col("first_t"), pairs(F.col("a")))).alias("same_t"),
        F.sum(F.when(F.col("first_p"), pairs(F.col("b")))).alias("same_p"),
        F.count_if("first_t").alias("k_t"),
        F.count_if("first_p").alias("k_p"),
    )
    n = F.col("n").cast("double")
    some = F.col("n") > 0
    h_t = F.when(some, F.ln(n) - F.col("ala") / n).otherwise(1.0)
    h_p = F.when(some, F.ln(n) - F.col("blb") / n).otherwise(1.0)
    mi = F.when(some, F.ln(n) + F.col("mi") / n).otherwise(0.0)
    s = s.withColumns({"entropy_truth": h_t, "entropy_pred": h_p, "mutual_info": mi})
    one = lambda h: F.when(~some | (F.abs(h) < 1e-12), F.lit(1.0)).otherwise(F.col("mutual_info") / h)
    s = s.withColumns({"homogeneity": one(F.col("entropy_truth")), "completeness": one(F.col("entropy_pred"))})
    h, c2 = F.col("homogeneity"), F.col("completeness")
    total = pairs(F.col("n"))
    expected = F.when(total > 0, F.col("same_t") * F.col("same_p") / total).otherwise(0.0)
    top = (F.col("same_t") + F.col("same_p")) / 2
    plain = (F.col("k_t") == F.col("k_p")) & ((F.col("k_t") == 1) | (F.col("k_t") == F.col("n")))
    s = s.withColumns(
        {
            "v_measure": divide_check_zero((1 + beta) * h * c2, beta * h + c2),
            "rand_index": F.when(F.col("n") < 2, 1.0).otherwise((total + 2 * F.col("both") - F.col("same_t") - F.col("same_p")) / total),
            "adjusted_rand": F.when((F.col("n") < 2) | plain, 1.0).otherwise(divide_check_zero(F.col("both") - expected, top - expected)),
        }
    )
    return s.select("entropy_truth", "entropy_pred", "mutual_info", "homogeneity", "completeness", "v_measure", "rand_index", "adjusted_rand")


def kl_divergence(df: DataFrame) -> DataFrame:
    """Sum of p (ln p - ln q) over ``(i, p, q)``; terms with p = 0 count 0."""
    return df.agg(F.sum(F.when(F.col("p") == 0, 0.0).otherwise(F.col("p") * (F.ln("p") - F.ln("q")))).alias("v"))


# clusterings ``(row, vec, label)``


def dispersion(centroids: DataFrame, sizes: DataFrame) -> DataFrame:
    """sqrt of the sum of size * squared distance to the global centre, for centroids ``(key, col, val)`` and ``(key, n)``."""
    joined = centroids.join(sizes, "key")
    centre = joined.groupBy("col").agg((F.sum(F.col("val") * F.col("n")) / F.sum("n")).alias("__c"))
    d = F.col("val") - F.col("__c")
    return joined.join(centre, "col").agg(F.sqrt(F.sum(F.col("n") * d * d)).alias("v"))


def _l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def silhouette_samples(points: DataFrame, metric: str = "sqeuclidean", most_clusters: int = 10_000) -> DataFrame:
    """``(row, v)``: silhouette, exact.

    ``sqeuclidean`` and ``cosine`` need no pairs of points: the mean squared distance to a cluster is
    |x|^2 - 2 x.mean + mean |y|^2, so one row of sums per cluster is enough, and a cosine distance is
    half the squared one of unit vectors. The clusters are joined to the points, which costs points
    times clusters; up to ``most_clusters`` of them, which are counted, are broadcast. ``euclidean``
    and ``linf`` compare all pairs of points once, in blocks; ``l1`` sorts the columns of blocks in their place.
    """
    if metric in ("euclidean", "l1", "linf"):
        return _silhouette_of_pairs(points, metric)
    if metric == "cosine":
        size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        points = points.withColumn("__size", size).withColumn("vec", F.transform("vec", lambda x: x / F.col("__size"))).drop("__size")
    elif metric != "sqeuclidean":
        raise ValueError(metric)
    dims = points.select("label", F.posexplode("vec").alias("i", "x"))
    sums = dims.groupBy("label", "i").agg(F.sum("x").alias("s")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sum"))
    sq = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    sizes = points.groupBy("label").agg(F.count("*").alias("n"), F.sum(sq(F.col("vec"))).alias("ss"))
    clusters = sums.join(sizes, "label").withColumnRenamed("label", "c")
    dot = F.aggregate(F.zip_with("vec", "sum", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    clusters = spill(clusters, "clusters")
    few = clusters.count() <= most_clusters
    total = points.withColumn("xx", sq(F.col("vec"))).crossJoin(F.broadcast(clusters) if few else clusters)  # points times clusters, as stated
    return _silhouette_of_sums(points, total.select("row", "label", "c", "n", (F.col("n") * F.col("xx") - 2 * dot + F.col("ss")).alias("d")))


def _silhouette_of_sums(points: DataFrame, total: DataFrame) -> DataFrame:
    """From ``(row, label, c, n, d)``: the sum d of distances from a point to the n points of each cluster c."""
    own = F.col("c") == F.col("label")
    per = total.groupBy("row").agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    return per.select("row", F.when((F.col("n") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("v"))


def _runs(labels):
    """(first places, values) of the runs of sorted labels."""
    import numpy as np

    first = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    return first, labels[first]


def _tile(metric, x, y, xx, yy):
    """Distances of rows to rows. Euclidean ones are products, but differences where digits would cancel."""
    import numpy as np

    from tessera.plans.grid import exact

    if metric == "euclidean":
        d = np.concatenate([-2 * x, xx[:, None], np.ones((len(x), 1))], axis=1) @ np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1).T
        near = np.flatnonzero(~(d.ravel() >= 1e-4 * (xx.max() + yy.max())))
        if len(near):
            d.ravel()[near] = exact(x, y, near // len(y), near % len(y))
        return np.sqrt(d, out=d)
    d, yt = np.empty((len(x), len(y))), np.ascontiguousarray(y.T)
    gap = np.empty_like(yt)
    for r, v in enumerate(x):
        np.abs(np.subtract(yt, v[:, None], out=gap), out=gap)
        (gap.sum if metric == "l1" else gap.max)(axis=0, out=d[r])
    return d


def _cluster_sums(metric, x, lx, y, ly, both):
    """Sums of distances from each x to each label of y and, if ``both``, from each y to each label of x; labels are sorted."""
    import numpy as np

    (fx, cx), (fy, cy) = _runs(lx), _runs(ly)
    to_y, to_x = np.zeros((len(x), len(cy))), np.zeros((len(cx), len(y)))
    if metric == "l1" and np.isfinite(x).all() and np.isfinite(y).all():
        return _l1_sums(x, y, fy), (_l1_sums(y, x, fx) if both else None)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    high, wide = (256, 2048) if metric == "euclidean" else (256, 512)
    for i in range(0, len(x), high):
        k = slice(np.searchsorted(fx, i, "right") - 1, np.searchsorted(fx, min(i + high, len(x))))
        for j in range(0, len(y), wide):
            m = slice(np.searchsorted(fy, j, "right") - 1, np.searchsorted(fy, min(j + wide, len(y))))
            d = _tile(metric, x[i : i + high], y[j : j + wide], xx[i : i + high], yy[j : j + wide])
            to_y[i : i + high, m] += np.add.reduceat(d, np.maximum(fy[m] - j, 0), axis=1)
            if both:
                to_x[k, j : j + wide] += np.add.reduceat(d, np.maximum(fx[k] - i, 0), axis=0)
    return to_y, (to_x.T if both else None)


def _l1_sums(x, y, first):
    """Sums of l1 distances from each x to each run of y, a column at a time: by sorted values and their prefix sums, without pairs."""
    import numpy as np

    out = np.zeros((len(first), len(x)))
    for d in range(x.shape[1]):
        order = np.argsort(x[:, d])
        v = x[order, d]
        for c, (a, b) in enumerate(zip(first, [*first[1:], len(y)])):
            w = np.sort(y[a:b, d])
            before = np.r_[0.0, np.cumsum(w)]
            at = np.searchsorted(w, v)
            out[c, order] += v * (2 * at - len(w)) + before[-1] - 2 * before[at]
    return out.T


def _silhouette_of_pairs(points: DataFrame, metric: str) -> DataFrame:
    """``(row, v)`` by comparing all points, block by block; a block's sums to each label meet in one task."""
    import numpy as np
    import pyarrow as pa

    from tessera.plans.grid import block_count, compare, packed, vecs_of

    n, labels = points.agg(F.count("*"), F.count_distinct("label")).first()
    most = 131_072 if metric == "l1" else 32_768
    blocks = block_count(n, max(256, min(most, 4_000_000 // max(1, labels))))
    p = packed(points, blocks, "label")

    def sums(a: dict, b: dict) -> pa.Table:
        x, y, lx, ly = vecs_of(a), vecs_of(b), np.frombuffer(a["labels"], "i8"), np.frombuffer(b["labels"], "i8")
        both = a["b"] != b["b"]
        to_y, to_x = _cluster_sums(metric, x, lx, y, ly, both)
        rows = []
        for at, sums_, other in ((a["b"], to_y, ly), (b["b"], to_x, lx)):
            if sums_ is not None:
                first, found = _runs(other)
                rows.append({"b": at, "found": found.tobytes(), "counts": np.diff(np.r_[first, len(other)]).astype("i8").tobytes(), "sums": sums_.tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("b", pa.int32()), ("found", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())]))

    def meet(t: pa.Table) -> pa.Table:
        rows = labels = None
        total, size = {}, {}
        for r in t.to_pylist():
            if r["found"] is None:
                rows, labels = np.frombuffer(r["rows"], "i8"), np.frombuffer(r["labels"], "i8")
                continue
            found = np.frombuffer(r["found"], "i8")
            for c, k, s in zip(found.tolist(), np.frombuffer(r["counts"], "i8").tolist(), np.frombuffer(r["sums"]).reshape(-1, len(found)).T):
                total[c], size[c] = total.get(c, 0) + s, size.get(c, 0) + k
        own = np.zeros(len(rows))
        count, near = np.zeros(len(rows)), np.full(len(rows), np.nan)
        with np.errstate(all="ignore"):
            for c, s in total.items():
                mine = labels == c
                own[mine], count[mine] = s[mine] / (size[c] - 1), size[c]
                near[~mine] = np.fmin(near[~mine], s[~mine] / size[c])
            top = np.maximum(own, near)
            v = np.where((count == 1) | (top == 0), 0.0, (near - own) / top)
        return pa.table({"row": rows, "v": pa.array(v, mask=(count > 1) & (len(total) == 1))})

    parts = compare(p, None, blocks, sums, "b int, found binary, counts binary, sums binary")
    parts = parts.unionByName(p.select("b", "rows", "labels"), allowMissingColumns=True)
    return parts.groupBy("b").applyInArrow(meet, "row long, v double")


def silhouette(points: DataFrame, metric: str = "sqeuclidean") -> DataFrame:
    return silhouette_samples(points, metric).agg(F.avg("v").alias("v"))


#: Points a block of :func:`nearest` and of ranks.
BLOCK = 32_768


def _products(x, y):
    """(squared distances as a function of a slice of x, in single precision, and a bound of their error a row of x)."""
    import numpy as np

    known = y[np.isfinite(y).all(axis=1)]
    centre = known.mean(axis=0) if len(known) else np.zeros(y.shape[1])
    x, y = x - centre, y - centre
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most = np.max(yy, initial=0.0, where=np.isfinite(yy))
    top = np.max(xx, initial=0.0, where=np.isfinite(xx)) + most
    kind = np.float32 if 1e-20 < top < 1e30 else np.float64
    left = np.concatenate([-2 * x, xx[:, None], np.ones((len(x), 1))], axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1).astype(kind).T)
    moved = 16 * np.finfo(float).eps * np.sqrt((centre * centre).sum()) * np.sqrt(xx + most)  # what the shift to the centre may round
    return (lambda at: left[at] @ right), (x.shape[1] + 8) * np.finfo(kind).eps * 2 * (xx + most) + moved


def nearest(points: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """``(row, other, rank)`` of the k nearest others by Euclidean distance, in blocks of matrix products.

    A pair of blocks keeps the k best of its queries. Products in single precision leave out what is
    farther than k others by more than their error; the rest is compared by exact differences, equal
    distances by row.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.plans.grid import block_count, compare, exact, packed, vecs_of

    blocks = blocks or block_count(points.count(), BLOCK)
    p = packed(points, blocks)

    def best(a: dict, b: dict) -> pa.Table:
        x, y, rows, others = vecs_of(a), vecs_of(b), np.frombuffer(a["rows"], "i8"), np.frombuffer(b["rows"], "i8")
        squares, slack = _products(x, y)
        head, found = min(len(y), max(2048, 4 * k)), []
        own = np.searchsorted(others, rows, "left").tolist(), np.searchsorted(others, rows, "right").tolist()
        for at in range(0, len(x), 256):
            d = squares(slice(at, at + 256))
            e = slack[at : at + 256]
            for r in range(len(d)):
                d[r, own[0][at + r] : own[1][at + r]] = np.inf  # a row isn't its own neighbour
            bound = (np.partition(d[:, :head], k - 1, axis=1)[:, k - 1] + 2 * e) if head > k else np.full(len(d), np.inf)
            q, o = np.divmod(np.flatnonzero(~(d > bound[:, None].astype(d.dtype))), len(y))
            order = np.lexsort((d[q, o], q))
            q, o = q[order], o[order]
            start = np.searchsorted(q, np.arange(len(d) + 1))
            last = np.minimum(start[:-1] + k - 1, np.maximum(start[1:] - 1, 0))
            keep = ~(d[q, o] > (d[q[last], o[last]] + 2 * e)[q]) if len(q) else np.zeros(0, bool)
            q, o = q[keep], o[keep]
            real = rows[at + q] != others[o]
            q, o = q[real], o[real]
            g = exact(x, y, at + q, o)
            order = np.lexsort((others[o], g, q))
            q, o, g = q[order], o[order], g[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            few = (place < k) & np.isfinite(g)
            found.append((rows[at + q[few]], others[o[few]], g[few]))
        return pa.table({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(("row", "other", "d"))})

    found = compare(p, p, blocks, best, "row long, other long, d double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("d", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("row", "other", F.col("rank").cast("long").alias("rank"))


def trustworthiness(original: DataFrame, embedded: DataFrame, k: int) -> DataFrame:
    """How far the k nearest neighbours in the embedding are also near in the original space.

    1 - 2 / (n k (2n - 3k - 1)) * sum of max(0, rank - k). Ranks are counted per neighbour pair,
    against all points, in the original space.
    """
    o = original.select("row", "vec")
    ranks = _ranks(spill(nearest(embedded, k), "near"), o)
    n = F.broadcast(o.agg(F.count("*").alias("n")))
    over = ranks.agg(F.sum(F.greatest(F.lit(0), F.col("rank") - k)).alias("s")).join(n)
    return over.select((1 - F.lit(2.0) / (F.col("n") * k * (2 * F.col("n") - 3 * k - 1)) * F.col("s")).alias("v"))


def _ranks(pairs: DataFrame, points: DataFrame, blocks: int | None = None) -> DataFrame:
    """(row, other, rank) of pairs ``(row, other, rank)``: the rank of each other among all points, counted block by block.

    Products in single precision count what is nearer by more than their error; what is within it is
    compared by exact differences.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.plans.grid import block_count, block_of, compare, exact, matrix_of, packed, vecs_of

    blocks = blocks or block_count(points.count(), BLOCK)
    p = packed(points, blocks)
    with_y = pairs.select("row", "other", F.col("rank").alias("place")).join(points.select(F.col("row").alias("other"), F.col("vec").alias("y")), "other")
    with_x = with_y.join(points.select("row", F.col("vec").alias("x")), "row").select("row", "other", "place", "x", "y", block_of(blocks).alias("b"))
    kind = "b int, n long, d long, k long, rows binary, others binary, limits binary, vecs binary"
    schema = pa.schema([("b", pa.int32())] + [(c, pa.int64()) for c in ("n", "d", "k")] + [(c, pa.binary()) for c in ("rows", "others", "limits", "vecs")])

    def pack(t: pa.Table) -> pa.Table:
        row, other, place = (np.asarray(t[c]) for c in ("row", "other", "place"))
        x = matrix_of(t["x"])
        rows, first, at = np.unique(row, return_index=True, return_inverse=True)
        k = int(place.max())
        others, limits = np.full((len(rows), k), -1, "i8"), np.full((len(rows), k), -np.inf)
        others[at, place - 1], limits[at, place - 1] = other, exact(x, matrix_of(t["y"]))
        one = {"b": t["b"][0].as_py(), "n": len(rows), "d": x.shape[1], "k": k, "rows": rows.astype("i8").tobytes(), "others": others.tobytes(), "limits": limits.tobytes(), "vecs": x[first].tobytes()}
        return pa.Table.from_pylist([one], schema=schema)

    queries = spill(with_x.groupBy("b").applyInArrow(pack, kind), "queries")

    def count(a: dict, b: dict) -> pa.Table:
        x, y, rows, ids = vecs_of(a), vecs_of(b), np.frombuffer(a["rows"], "i8"), np.frombuffer(b["rows"], "i8")
        others, limits = (np.frombuffer(a[c], t).reshape(-1, a["k"]) for c, t in (("others", "i8"), ("limits", "f8")))
        squares, slack = _products(x, y)
        n = np.zeros(limits.shape, "i8")
        own = np.searchsorted(ids, rows, "left").tolist(), np.searchsorted(ids, rows, "right").tolist()
        for at in range(0, len(x), 64):
            d = squares(slice(at, at + 64))
            for r in range(len(d)):
                d[r, own[0][at + r] : own[1][at + r]] = np.inf
            low, high = np.empty(d.shape, bool), np.empty(d.shape, bool)
            e = 2 * slack[at : at + 64]
            for c in range(a["k"]):
                t = limits[at : at + 64, c]
                np.less(d, (t - e).astype(d.dtype)[:, None], out=low)
                np.less_equal(d, (t + e).astype(d.dtype)[:, None], out=high)
                n[at : at + 64, c] += [np.count_nonzero(r) for r in low]
                q, o = np.divmod(np.flatnonzero(np.not_equal(low, high, out=high)), len(y))
                g, t, other = exact(x, y, at + q, o), t[q], others[at + q, c]
                nearer = ((g < t) | ((g == t) & (ids[o] < other))) & (ids[o] != rows[at + q]) & (ids[o] != other)
                n[at : at + 64, c] += np.bincount(q[nearer], minlength=len(d))
        real = np.isfinite(limits) | (others >= 0)
        return pa.table({"row": np.repeat(rows, a["k"])[real.ravel()], "other": others[real], "n": n[real]})

    counted = compare(queries, p, blocks, count, "row long, other long, n long")
    return counted.groupBy("row", "other").agg((F.sum("n") + 1).alias("rank"))


def neighborhood_recall(found: DataFrame, reference: DataFrame, eps: float | None = None) -> DataFrame:
    """Share of found neighbours ``(row, pos, id[, dist])`` that are among the reference's of the row.

    With distances, one within a relative ``eps`` of a reference distance counts too; each found
    neighbour counts once at most.
    """
    key = ["row", "id"]
    hit = found.join(reference.select(*key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    if eps is not None:
        dists = reference.groupBy("row").agg(F.collect_list("dist").alias("__d"))
        near = F.exists("__d", lambda r: F.abs(F.col("dist") - r) <= F.lit(eps) * F.greatest(F.abs("dist"), F.abs(r)))
        hit = hit.join(dists, "row", "left").withColumn("__hit", F.when(F.col("__hit").isNotNull() | near, 1))
    return hit.agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.count("*")).alias("v"))
