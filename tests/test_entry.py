"""The registered queries against their SQL, and the import without the llm folders."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from tallyloom.plans.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def engine():
    if not DATA.is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)[:19]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    other = engine.sql(SQL[name])
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    rows = df.collect()
    assert sorted(tuple(cell(r[c]) for c in columns) for r in rows) == sorted(tuple(cell(r[i]) for i in at) for r in other.fetchall())


def test_entry_works_without_llm(tmp_path):
    for p in ("__spark_entry__.py", "tallyloom"):
        source = ROOT / p
        if source.is_dir():
            shutil.copytree(source, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
