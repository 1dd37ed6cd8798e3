"""Queries that read whole tables: results of every row against numpy, on tables larger than any fixed count."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import tessera.queries  # noqa: F401
from tessera.registry import QUERIES

MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", MORE])
def test_csr_offsets(spark, d):
    keys = pq.read_table(f"{d}/lineitem.parquet", columns=["l_orderkey"])["l_orderkey"].to_numpy()
    n = np.bincount(keys)
    out = QUERIES["csr_offsets"](spark, d).orderBy("row").toPandas()
    assert out["row"].tolist() == list(range(keys.max() + 1))
    assert out["start"].tolist() == [0, *np.cumsum(n)[:-1].tolist()]


def _vectors(d):
    t = pq.read_table(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    assert t["vec_id"].to_pylist() == list(range(t.num_rows))
    return np.array(t["embedding"].to_pylist(), "f4").astype(float)


def _whole(spark, name, d):
    """The query's result as a matrix; each cell stands there once."""
    out = QUERIES[name](spark, d)
    if "vec" in out.columns:
        rows = out.orderBy("row").collect()
        assert [r["row"] for r in rows] == list(range(len(rows)))
        return np.array([r["vec"] for r in rows])
    t = out.toPandas()
    m = np.full((t["row"].max() + 1, t["col"].max() + 1), np.nan)
    assert len(t) == m.size
    m[t["row"], t["col"]] = t["val"]
    return m


@pytest.mark.parametrize("name", ["copy_rows", "reverse_rows", "shift_rows", "serialize_npy"])
def test_all_embeddings(spark, sf, name):
    x = _vectors(sf)
    wanted = {
        "copy_rows": lambda: x[np.arange(len(x)) * 7 % len(x)],
        "reverse_rows": lambda: x[::-1],
        "shift_rows": lambda: np.vstack([np.full((2, x.shape[1]), 7.0), x[:-2]]),
        "serialize_npy": lambda: x,
    }[name]()
    assert np.array_equal(_whole(spark, name, sf), wanted)


def _dense(cells):
    t = cells.toPandas()
    m = np.zeros((t["row"].max() + 1, t["col"].max() + 1))
    m[t["row"], t["col"]] = t["val"]
    return m


def test_sparse_solvers(spark, sf, monkeypatch):
    from tessera.operators import linalg
    from tessera.queries.common import order_part
    from tessera.queries.linalg import _customers

    where = []
    times = linalg.SparseOperator.times
    monkeypatch.setattr(linalg.SparseOperator, "times", lambda self, x, trans=False: where.append(self.local) or times(self, x, trans))
    m = _dense(_customers(spark, sf)[0])
    w = np.linalg.eigvalsh(m)
    assert len(m) == 150 and np.allclose(m, m.T)
    assert np.allclose([r.v for r in QUERIES["lanczos_customers"](spark, sf).orderBy("v").collect()], w[-4:], rtol=1e-8)
    t = QUERIES["eigsh_customers"](spark, sf).orderBy("k", "i").toPandas()
    x = t["x"].to_numpy().reshape(3, -1).T
    assert np.allclose(t["value"].to_numpy()[:: len(m)], w[-3:], rtol=1e-8) and np.allclose(m @ x, x * w[-3:], atol=1e-4 * w[-1])
    s = np.linalg.svd(_dense(order_part(spark, sf)), compute_uv=False)
    assert np.allclose([r.v for r in QUERIES["randomized_svds_orders"](spark, sf).orderBy("v", ascending=False).collect()], s[:3], rtol=1e-3)
    assert where and all(x is None for x in where)
