"""Every registered graph query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from weft.catalog import ORACLES, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in NAMES:
        if os.path.exists(path := f"{small}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(rows, names):
    return sorted([tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in (r[n] for n in names)) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, sql, name):
    frame = QUERIES[name](spark, small)
    relation = sql.sql(ORACLES[name])
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    expected = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert plain([r.asDict() for r in frame.collect()], names) == plain(expected, names)


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_llm_folders(tmp_path, pipeline):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not os.path.exists(f"{copy}/weft/llm") and not os.path.exists(f"{copy}/tests/llm") and os.path.exists(f"{copy}/corpus_pipeline.py") == pipeline
    code = "import pkgutil, importlib, weft, bench, __spark_entry__ as e; [importlib.import_module(m.name) for m in pkgutil.walk_packages(weft.__path__, 'weft.')]; from weft.catalog import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
