"""Every query of the reporting part against its DuckDB oracle at sf0.01 (same
comparison as the driver: sorted column names, row count, values)."""
import math
import os

import pytest

import __spark_entry__ as E
from conftest import SF001

from panelkit.plans.catalog import QUERIES
from panelkit.plans.oracle import ORACLE


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda t: tuple((x is None, type(x).__name__, x if x is not None else 0)
                                                 for x in t))


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    import duckdb
    from panelkit.sources.tables import DRIVER_TABLES
    con = duckdb.connect()
    scratch = tmp_path_factory.mktemp("duck")
    con.execute(f"SET temp_directory='{scratch}'; SET max_temp_directory_size='2GB'; SET memory_limit='8GB'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF001).toPandas()
    dk = duck.execute(ORACLE[name]).fetchdf()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "metric" in df.columns
