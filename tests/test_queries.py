"""Every query against the SQL that states its result, in another engine."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from folioflow.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["folioflow/llm", "tests/llm"], ["folioflow/llm", "tests/llm", "corpus_pipeline.py"]])
def test_rest_stands_alone(tmp_path, gone):
    """Without the training-data folders the entry points work and offer everything else."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in gone:
        at = tmp_path / "repo" / x
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    said = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    out = subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out == [" ".join(sorted(QUERIES)), " ".join(sorted(SQL))]
