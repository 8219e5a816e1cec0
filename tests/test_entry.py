import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p2_found" in q
    assert entry.entry(spark).columns == ["entity", "scan_id", "item_key", "change"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda data, names: sorted([tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in data])
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)
