"""The driver's contract, and queries against their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from spanloom.plans import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def rows_of(df):
    """Rows as sorted tuples; integers and floats compare alike, null as None."""
    import math

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


def test_every_sql_has_its_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and "p0_language_profile" in queries


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    top = shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".hypothesis", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p0_language_profile' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    for names in ((), ("corpus_pipeline.py",)):
        for n in names:
            (top / n).unlink()
        subprocess.run([sys.executable, "-B", "-c", code], cwd=top, check=True, env=os.environ | {"PYTHONPATH": str(top)})


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = registry.QUERIES[name](spark, SF)
    assert rows_of(got.toPandas()) == rows_of(con.execute(registry.ORACLES[name]).df())


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
