"""Every query with SQL against DuckDB at the smallest scale; the entry module without the corpus subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from spindrift.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def tidy(row):
    return tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    want = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tidy(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tidy(r)) for r in want)


@pytest.mark.parametrize("gone", [("spindrift/llm", "tests/llm", "corpus_pipeline.py"), ("spindrift/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_subpackage(tmp_path, gone):
    """In a copy of the repository from which the folders, or the pipeline alone, are deleted, the rest imports, and its tests are found; some of them run."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        shutil.copy(f"{root}/{name}", copy)
    for name in ("spindrift", "tests"):
        shutil.copytree(f"{root}/{name}", copy / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = """
import sys
import __spark_entry__ as e
names = [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert len(e.queries()) - len(names) > 80 and len(e.oracle_sql()) > 80
print(len(names))
"""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]  # others may hold what the tests need
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *paths])}

    def run(*command):
        done = subprocess.run([sys.executable, *command], cwd=copy, timeout=240, env=env, capture_output=True, text=True)
        assert not done.returncode, f"{command}: {done.stdout[-3000:]} {done.stderr[-3000:]}"
        return done.stdout

    assert int(run("-c", code)) == (0 if "spindrift/llm" in gone else 13)
    left = ["tests"] if "spindrift/llm" in gone else ["tests", "--ignore=tests/llm"]
    assert "test_hot_keys" in run("-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", *left)
    run("-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_functions.py", "-k", "tokens or shared_is or ids_and_units or rollups")
