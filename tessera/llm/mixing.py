"""Mixing sources to target weights by distributed prefix sums over hash-random keys.

Each document gets a random key that is a hash of its identifier. Within its source the documents
are sorted by that key in two levels: key ranges, whose totals are summed up first, and the order
inside a range. The running total of a document is then the total of the ranges before its own plus
the running total inside it; no task sees more than one range of one source, however large the
source. The mix takes whole passes over a source and cuts the last one at the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.names import fresh
from tessera.plans.scratch import spill
from tessera.plans.skew import skew_join

WORD = r"[^ \t-\r]+"
_KEY_BITS = 60
FEW_SOURCES = 100_000  # up to here a row for each source is broadcast: some megabytes


def word_count(text: Column) -> Column:
    """Number of words that spaces and the five ASCII line and tab characters part; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(ident: Column, seed: int) -> Column:
    """60 uniform bits that depend on the identifier and the seed only."""
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``(skey, source_size, target)`` from ``(skey, source_size)``.

    Sources in the order of ``skey`` weigh ``weights`` in turn and share ``percent`` of all words.
    A target stops at ``most`` times the source; what is over goes to the others by weight, until
    none is above: sources are ranked by cap over weight, and those below the cut that this makes
    are capped, the rest get the same amount per unit of weight. All sums are exact integers.
    """
    scale = 1
    for w in set(weights):
        scale *= w
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    big = "decimal(38,0)"
    s = sizes.withColumn("w", pick.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap").cast(big) * (F.lit(scale) / F.col("w")).cast("long")).alias("r"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "nth": F.row_number().over(order),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    # hundredths of words that are left for this source and those ranked after it
    s = s.withColumn("left100", F.col("total").cast(big) * percent - F.col("cap_before").cast(big) * 100)
    fits = F.col("left100") * F.col("w") <= F.col("cap").cast(big) * 100 * F.col("w_left")
    cut = s.where(fits).agg(F.min_by(F.struct("nth", "left100", "w_left"), "nth").alias("cut"))
    s = s.select("skey", "source_size", "w", "cap", "nth").join(F.broadcast(cut), F.lit(True), "left")
    free = F.col("cut.left100").cast("double") * F.col("w").cast("double") / (F.lit(100.0) * F.col("cut.w_left").cast("double"))
    capped = F.col("cut").isNull() | (F.col("nth") < F.col("cut.nth"))
    return s.select("skey", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(free).alias("target"))


def _skey(source: Column) -> Column:
    """Sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: int = 17,
    rows_a_range: int = 4_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts the words of the text (null: 0); a null source is a source of its own, last in
    order. ``taken`` is the number of words the mix takes from the document: each full pass takes
    all of them, the last pass takes what lies before the budget, so that the document at the cut
    may give a part. The sum over a source is its target rounded to a whole word. Rows with equal
    keys are ordered by identifier, then size. Empty texts give 0; an empty table gives no rows.
    """
    out = _planned(docs, id_col, text_col, source_col, weights, percent, most, seed, rows_a_range)
    cut = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + cut).cast("long").alias("taken"))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: int = 17,
    rows_a_range: int = 4_000,
) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as the mix takes it; same columns.

    The plan of :func:`mix_sources` comes down to a number of passes and a last key per source. The
    document at the cut is taken once more if the mix takes at least half of it. A document without
    words is taken as often as any with its key would be. A null source is a source of its own, null
    identifiers share one key, repeated rows are taken alike; an empty table gives no rows.
    """
    plan = _planned(docs, id_col, text_col, source_col, weights, percent, most, seed, rows_a_range)
    left = F.col("rest") - F.col("before")
    inside = (left > 0) & (2 * left >= F.col("size"))
    skey, key, passes, cut, nth = (fresh(c, docs.columns) for c in ("skey", "key", "passes", "cut", "nth"))
    cuts = plan.groupBy(F.col("skey").alias(skey)).agg(F.first("passes").alias(passes), F.max(F.when(inside, F.col("key"))).alias(cut))
    cuts = spill(cuts, "cuts")
    keyed = docs.withColumns({skey: _skey(F.col(f"`{source_col}`")), key: random_key(F.col(f"`{id_col}`"), seed)})
    # one row a source: with few of them no document has to move
    keyed = keyed.join(F.broadcast(cuts), skey) if cuts.count() <= FEW_SOURCES else skew_join(keyed, cuts, [skey])
    times = F.col(passes) + F.when(F.col(key) <= F.col(cut), 1).otherwise(0)
    repeated = keyed.withColumn(nth, times.cast("int")).where(F.col(nth) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])


def _planned(docs, id_col, text_col, source_col, weights, percent, most, seed, rows_a_range) -> DataFrame:
    """Per document: skey, key, size, its source's size, target, passes and rest, and the words before it."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        _skey(F.col(source_col)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), seed).alias("key"),
    )
    rows = spill(rows, "sizes")
    ranges = max(1, rows.count() // rows_a_range)
    bits = min(_KEY_BITS, max(0, (ranges - 1).bit_length()))
    rows = rows.withColumn("part", F.shiftright("key", _KEY_BITS - bits))
    parts = rows.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, percent, most)
    ahead = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    plan = parts.join(targets, "skey")
    inside = Window.partitionBy("skey", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["skey", "part"])
    budget = F.round("target").cast("long")
    safe = F.greatest("source_size", F.lit(1))
    rest = F.pmod(budget, safe)
    return out.select(
        "doc_id", "skey", "key", "size", "source_size", "target", ((budget - rest) / safe).cast("long").alias("passes"), rest.alias("rest"), (F.col("ahead") + F.col("inside")).alias("before")
    )
