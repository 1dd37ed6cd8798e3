"""Count, mean and variance per key over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_mean_var(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The running moments of a streaming DataFrame, for an output mode of ``complete`` or ``update``.

    The state of a key is one mergeable triple (count, mean, sum of squares), as in the batch form.
    """
    return stream.groupBy(F.col(key).alias("key")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))


def stream_histogram(stream: DataFrame, value: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Running counts of equal bins; values outside go to the first and last one."""
    at = F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.floor((F.col(value) - lo) / ((hi - lo) / n_bins)))).cast("long")
    return stream.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def run_available(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Feed a table's files through the stream once and return the final moments."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    out = f"moments_{uuid.uuid4().hex}"
    query = stream_mean_var(stream, key, value).writeStream.outputMode("complete").format("memory").queryName(out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(out)
