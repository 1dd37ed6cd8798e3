r"""Secret scanning with corpus-wide ownership frequency.

Candidates come from four patterns over whole texts. The hash of each candidate's value is counted
over the corpus by distinct repositories and owners. A value that many owners or many repositories
have is a widely copied example; one that a single owner has in few repositories and that mixes
character classes looks live. Long
mixed tokens that stand alone (kind ``bare``) are reported only when the counts make them
owner-specific; matches of the other three kinds are always reported.

Only DataFrame functions are used. Positions come from the lengths of what lies between matches,
summed up by a window over one text's few matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import spill
from tessera.plans.skew import skew_join

# The patterns of the three base kinds and of the added kind, in the order in which spans at one place are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
KINDS = ("assign", "access", "hex", "bare")
_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE), strict=True))


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap, value): code points since the end of the match before, and the match."""
    pattern = F.lit(_PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, _PATTERNS[kind], -1), lambda x: F.length(x))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    return F.when(F.regexp_like(text, pattern), both)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = 3,
    example_repositories: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live, n_example.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start, then kind;
    ``base_sha256`` is the hash of that list without the added kind. ``n_live`` counts spans whose
    value mixes letters and digits and that one owner has in fewer than ``example_repositories``
    repositories, ``n_example`` those whose value ``example_owners`` owners or more have, or
    ``example_repositories`` repositories or more, of whatever owners. A null owner or repository is one owner or repository.
    A null text counts as empty: counts of 0, an empty list. Rows with the same identifier are
    kept apart; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("\0")).alias("repo"),
        *[_matches(text, k).alias(k) for k in KINDS],
    )
    found = spill(found, "matches")
    each = None
    for nth, kind in enumerate(KINDS):
        x = found.where(F.col(kind).isNotNull()).select("row", "doc_id", "owner", "repo", F.lit(nth).alias("nth"), F.posexplode(kind).alias("i", "m"))
        each = x if each is None else each.unionByName(x)
    upto = Window.partitionBy("row", "nth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("row", "doc_id", "owner", "repo", "nth", "i", "m.gap", F.col("m.value").alias("match"))
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    each = each.withColumn("start", F.col("end") - F.length("match"))
    group2 = F.regexp_extract("match", ASSIGN, 2)
    each = each.withColumn("value", F.when(F.col("nth") == 0, group2).otherwise(F.col("match")))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    all_three = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    each = each.where(((F.col("nth") == 0) & (F.length("value") >= 12)) | F.col("nth").isin(1, 2) | ((F.col("nth") == 3) & all_three))
    each = spill(each.select("row", "doc_id", "owner", "repo", "nth", "start", "end", F.unhex(F.sha2("value", 256)).alias("hash"), mixed.alias("mixed")), "candidates")
    counts = ownership(each)
    marked = skew_join(each, counts, ["hash"], "left")
    # a bare token inside a base match says nothing new
    own = Window.partitionBy("row")
    base_reach = F.max(F.when(F.col("nth") < 3, F.col("end"))).over(own.orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, -1))
    next_base = F.min(F.when(F.col("nth") < 3, F.col("start"))).over(own.orderBy("start", "nth").rowsBetween(1, Window.unboundedFollowing))
    marked = marked.withColumns({"reach": base_reach, "next_base": next_base})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next_base").isNull() | (F.col("next_base") >= F.col("end")))
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repositories)
    live = (F.col("n_owners") == 1) & ~example & F.col("mixed")
    marked = marked.withColumns({"live": live, "example": example}).where((F.col("nth") < 3) | (live & clear))
    span = F.struct("start", "nth", F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("nth") + 1), "start", "end").alias("span"))
    spans = marked.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(span)).alias("all"),
        *[F.count_if(F.col("nth") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    base = F.filter("all", lambda x: x["nth"] < 3)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    counted = ["n_assign", "n_access", "n_hex", "n_bare", "n_live", "n_example"]
    some = spans.select("row", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), *counted)
    out = found.select("row", "doc_id").join(some, "row", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted],
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repos, n_seen)`` from candidates with owner and repo.

    Counts shrink in three grouped steps, so that a value in a third of all rows reaches its last
    task as one row per owner.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen"))
