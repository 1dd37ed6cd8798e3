"""Size of the Arrow batches that go between the JVM and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let the session's Arrow batches hold ``most`` bytes at most, a longer row alone in its own.

    By rows alone, ten thousand whole texts would come at once, twice over in the JVM and once in
    Python. A lower bound that the session has already stays.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_KEY))
    if now <= 0 or now > most:
        spark.conf.set(_KEY, f"{most}b")
