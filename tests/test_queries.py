"""Every query of the library against its SQL, and the registry without the training-data operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from packframe import queries as Q

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df):
    c = sorted(df.columns)
    return c, sorted(repr([plain(v) for v in x]) for x in df[c].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    got = Q.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in Q.oracle_sql():
        assert rows(got) == rows(db.execute(Q.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(Q.queries()) - set(Q.oracle_sql()) == set()


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/packframe", tmp_path / "packframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'diff_orders' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql(); print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.strip() == "fine", got.stderr
