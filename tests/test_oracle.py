"""Every registered query against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from inkspan.plans.queries import ORACLE_SQL, QUERIES

SLOW = {"gaussian_1d"}


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == want


def test_entry_imports_without_the_llm_folders(tmp_path):
    """The entry module and all page queries stand without the training-data folders."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "inkspan", tmp_path / "inkspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'op10_exact_dedup' not in q and len(q) > 30; e.oracle_sql()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
