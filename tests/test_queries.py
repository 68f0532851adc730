"""Every registered query that has an oracle against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from wavedeck.plans import queries, roundtrips

QUERIES = queries.QUERIES | roundtrips.QUERIES
ORACLES = queries.ORACLES | roundtrips.ORACLES
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name not in ORACLES:
        return
    found = duck.sql(ORACLES[name])
    names = list(found.columns)
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == expected
    types = dict(zip(names, map(str, found.types)))
    assert [types[c] for c in columns] == [TYPES[dict(df.dtypes)[c]] for c in columns]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["country", "runs", "calls", "last_call"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/wavedeck", tmp_path / "wavedeck", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
