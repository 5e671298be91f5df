"""Every registered query of the corpus and lexicon engine against its SQL twin, on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

from verbatlas.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if isinstance(value, (list, dict, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(normal(r[i]) for i in order)) for r in result.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_operators(tmp_path):
    """A folder that holds compiled files only, as a deletion may leave it, is no subpackage."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "verbatlas", tmp_path / "verbatlas", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "verbatlas" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "0"]
