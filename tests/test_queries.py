"""Every registered query against DuckDB on the same tables."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog, flows, small, variety  # noqa: F401  (registers its queries)

from .conftest import SF


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.5f}"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
