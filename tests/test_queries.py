"""Every table query against its SQL in DuckDB, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from plumbline.plans.table_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted((tuple(r) for r in want), key=repr)


def test_works_without_the_llm_subpackage(tmp_path):
    for part in ("plumbline", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    package = tmp_path / "plumbline"
    package.mkdir()
    for child in (ROOT / "plumbline").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (package / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n[:2] == 'op' and n[2].isdigit()] and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text(), path
