"""Registered queries against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def _entries():
    from talkmill import entries

    return entries


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(_entries().queries()))
def test_query(spark, con, name):
    df = _entries().queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    sql = _entries().oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "talkmill", tmp_path / "talkmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": os.environ["PATH"], "HOME": str(tmp_path)})
