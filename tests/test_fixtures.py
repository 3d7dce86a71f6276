"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from draftlens.plans import drawings, files, fixtures, review, shapes, texts  # noqa: F401  (each adds its queries to those of fixtures)

SF = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(fixtures.QUERIES))
def test_equals_sql(spark, duck, name):
    df = fixtures.QUERIES[name](spark, SF)
    got = duck.execute(fixtures.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(tidy(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=repr)
    have = sorted((tuple(tidy(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert have == want


def test_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "draftlens", tmp_path / "draftlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'inspect_result' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
