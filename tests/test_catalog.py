"""Every registered query runs, and agrees with its SQL where it has one."""

import duckdb
import numpy as np
import pytest

from folioscan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def order(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    sql = catalog.oracle_sql().get(name)
    frame = got.toPandas()
    if sql is None:
        return
    want = duck.sql(sql).df()
    assert sorted(frame.columns) == sorted(want.columns)
    frame, want = frame.sort_index(axis=1), want.sort_index(axis=1)

    def plain(df):
        return sorted(([None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r] for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=order)

    assert plain(frame) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_training_operators(tmp_path):
    """Without the llm folders and the pipeline, the entry point still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "folioscan", tmp_path / "folioscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'check_score' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
