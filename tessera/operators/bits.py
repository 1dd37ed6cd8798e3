"""Bit sets as ``(word, bits)``: 32,768 bits a row, in the layout of Spark's bitmap functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_indices(at: DataFrame, i: str = "i") -> DataFrame:
    """A set with the given indices; partial bitmaps are made before the shuffle."""
    x = F.col(i) + 1  # Spark's buckets begin at 1
    return at.groupBy(F.bitmap_bucket_number(x).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))


def bitset(flags: DataFrame) -> DataFrame:
    """Flags ``(i, bit)`` as they are: the unpacked form."""
    return flags.select("i", "bit")


def popcount(words: DataFrame, max_len: int | None = None, width: int = 32) -> DataFrame:
    """Number of set bits of rows ``(at, word)``, of the first ``max_len`` bits if given."""
    word = F.col("word").cast("long")
    if max_len is not None:
        left = F.greatest(F.lit(0), F.least(F.lit(width), F.lit(max_len) - F.col("at") * width)).cast("int")
        word = F.when(left <= 0, F.lit(0).cast("long")).when(left >= 64, word).otherwise(word.bitwiseAND(F.expr("shiftleft(1L, __left) - 1")))
        words = words.withColumn("__left", left)
    return words.agg(F.coalesce(F.sum(F.bit_count(word)), F.lit(0)).cast("long").alias("n"))


def to_flags(packed: DataFrame, size: int) -> DataFrame:
    """The unpacked form ``(i, bit)`` of a set with ``size`` places."""
    at = packed.sparkSession.range(size).select(F.col("id").alias("i"))
    return test(packed, at)


def resize(flags: DataFrame, size: int, bit: bool = False) -> DataFrame:
    """Places from ``size`` on go; new ones get ``bit``."""
    grid = flags.sparkSession.range(size).select(F.col("id").alias("i"))
    return grid.join(flags, "i", "left").select("i", F.coalesce("bit", F.lit(bit)).alias("bit"))


def count(packed: DataFrame) -> DataFrame:
    return packed.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def flip(flags: DataFrame) -> DataFrame:
    return flags.select("i", (~F.col("bit")).alias("bit"))


def set_bits(flags: DataFrame, at: DataFrame, value: bool = True) -> DataFrame:
    marked = at.select("i").distinct().withColumn("__m", F.lit(value))
    return flags.join(marked, "i", "left").select("i", F.coalesce("__m", "bit").alias("bit"))


def repeat(flags: DataFrame, times: int, size: int) -> DataFrame:
    n = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t")
    return flags.select("i", "bit", n).select((F.col("i") + F.col("t") * size).alias("i"), "bit")


def test(packed: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` with a column ``bit``: whether index ``i`` is in the set."""
    x = F.col("i") + 1
    pos = F.bitmap_bit_position(x)
    out = at.withColumn("word", F.bitmap_bucket_number(x)).join(packed, "word", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.withColumn("bit", F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))).drop("word", "bits")


def summary(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("size"), F.count_if("bit").alias("n_set"), F.count_if(~F.col("bit")).alias("n_flipped"), F.bool_or("bit").alias("any_set"), F.bool_and("bit").alias("all_set"))
