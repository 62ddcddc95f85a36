"""Every registered query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from vectrove.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SLOW = {n for n in QUERIES if n.startswith(("t1", "t2", "m22", "x02")) and n not in SQL}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else v


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a), abs(b))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: [(x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in row]
    mine = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=key)
    assert len(mine) == len(theirs)
    assert all(all(close(a, b) for a, b in zip(x, y)) for x, y in zip(mine, theirs))


@pytest.mark.parametrize("name", ["t01_spherical_kmeans", "t15_pca_2d", "t17_oos_predictions", "m25_confounder_models"])
def test_model_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_the_rest_imports_without_the_corpus_package(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told = "import __spark_entry__ as e; import vectrove.plans.catalog as c; assert set(e.queries()) == set(c.queries()) and set(e.oracle_sql()) == set(c.oracle_sql()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(QUERIES), out.stderr
