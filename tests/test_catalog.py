"""Every query that has SQL, against DuckDB."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from palimpsest.plans.catalog import ORACLE_SQL, QUERIES


def normal(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = normal(tuple(r[c] for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == normal(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """Only the entry point looks for the subpackage, and it does without."""
    root = os.path.dirname(driver.__file__)
    for f in ("__spark_entry__.py", "palimpsest"):
        os.symlink(f"{root}/{f}", tmp_path / f) if f.endswith(".py") else None
    (tmp_path / "palimpsest").mkdir()
    for f in os.listdir(f"{root}/palimpsest"):
        if f not in ("llm", "__pycache__"):
            os.symlink(f"{root}/palimpsest/{f}", tmp_path / "palimpsest" / f)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False"], said.stderr
