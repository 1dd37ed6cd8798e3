"""Tables written to the folder that driver and executors share.

A written table cuts lineage: what reads it does not need the tasks that made it, so a lost
executor costs only the tasks in flight. The folder is the session's ``spark.checkpoint.dir``;
only a local session in which it is unset gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_AT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; ``ValueError`` on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_root(spark: SparkSession) -> str:
    """One folder for this application, removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spill(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _AT[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`spill` wrote and that no plan reads any more."""
    for table in tables:
        path = _AT.pop(table, None)
        if path:
            drop_path(table.sparkSession, path)
