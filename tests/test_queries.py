"""Every named query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import queries as named

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(named.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = named.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = db.sql(named.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(str(r) for r in want.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["batch_id", "estimate_ms"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """With its optional folders gone, the entry module still lists the library's own queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=skip)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("said", len(e.queries()), all(isinstance(s, str) for s in e.oracle_sql().values()), e.entry(spark).count() > 0, e.queries()["closure_cyclic"](spark, e.SMALL).count() > 0)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split("said")[1].split() == [str(len(named.queries())), "True", "True", "True"]


def test_all_sql_is_text():
    import __spark_entry__

    assert all(isinstance(s, str) for s in __spark_entry__.oracle_sql().values())
