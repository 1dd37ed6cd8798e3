"""Arrays in the ``.npy`` format: scalars and small arrays as one file, tall matrices as one file a task."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_bytes(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(x), allow_pickle=False)
    return out.getvalue()


def from_bytes(raw: bytes, shape: tuple | None = None, dtype=None) -> np.ndarray:
    """The array; ``ValueError`` if its shape or type is another than the one asked for."""
    x = np.load(io.BytesIO(raw), allow_pickle=False)
    if shape is not None and x.shape != tuple(shape) or dtype is not None and x.dtype != np.dtype(dtype):
        raise ValueError(f"found {x.dtype} {x.shape}")
    return x


def read_header(raw: bytes) -> tuple[tuple, bool, np.dtype]:
    """(shape, whether in Fortran order, type)."""
    f = io.BytesIO(raw)
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def write_header(shape: tuple, dtype, fortran: bool = False) -> bytes:
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"shape": tuple(shape), "fortran_order": fortran, "descr": np.lib.format.dtype_to_descr(np.dtype(dtype))})
    return f.getvalue()


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_rows(rows: DataFrame, path: str) -> None:
    """``(row, vec)`` as pairs of files: ``*-rows.npy`` with the numbers, ``*-vec.npy`` with the matrix.

    A task writes under a name of its attempt and renames both files when they are whole.
    """

    def run(batches):
        at, parts = [], []
        for batch in batches:
            if batch.num_rows:
                at.append(np.asarray(batch.column(0)))
                parts.append(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
        if at:
            fs, base = _open(path)
            fs.create_dir(base, recursive=True)
            first = int(at[0][0])
            for kind, x in (("rows", np.concatenate(at)), ("vec", np.concatenate(parts))):
                temp = f"{base}/{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temp) as out:
                    out.write(to_bytes(x))
                fs.move(temp, f"{base}/part-{first:012d}-{kind}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([len(x)])], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The matrix that :func:`write_rows` wrote, one pair of files a task."""
    fs, base = _open(path)
    names = sorted(f.path.rpartition("/")[2] for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith("-rows.npy"))
    schema = "row long, vec array<double>"
    if not names:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, base = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as f:
                    at = from_bytes(f.read())
                with fs.open_input_stream(f"{base}/{name.replace('-rows', '-vec')}") as f:
                    x = from_bytes(f.read()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], ["row", "vec"])

    return spark.createDataFrame(pa.table({"name": names})).repartition(len(names), "name").mapInArrow(run, schema)


def scalar_to_bytes(value) -> bytes:
    return to_bytes(np.asarray(value))


def scalar_from_bytes(raw: bytes):
    return from_bytes(raw, ()).item()


__all__ = ["from_bytes", "read_header", "read_rows", "scalar_from_bytes", "scalar_to_bytes", "to_bytes", "write_header", "write_rows"]
