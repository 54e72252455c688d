"""Every catalogue query against its SQL, and the entry without the optional folders."""

import decimal
import numbers
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyspark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, numbers.Number | decimal.Decimal):
        return round(float(x), 6)
    return str(x)[:10] if hasattr(x, "year") else str(x)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    theirs = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and ours == theirs


def test_entry_without_optional_folders(tmp_path):
    root = Path(__file__).parents[1]
    for item in ("__spark_entry__.py", "tallyspark"):
        (shutil.copytree if (root / item).is_dir() else shutil.copy)(root / item, tmp_path / item)
    shutil.rmtree(tmp_path / "tallyspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
