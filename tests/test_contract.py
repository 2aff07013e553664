"""Every registered signal query against its SQL, on the small tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot say (filters backwards, transforms of whole channels, reweighted fits, a loop's state); other tests hold their operators against numpy.
WITHOUT_SQL = {"zero_phase_filter", "phase_measures", "phase_frames", "coherence_frames", "coupling_frames", "coupling_summary", "feedback_loop", "spectral_table"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    return sorted(tuple("~" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_queries_equal_sql(spark):
    import duckdb

    from wavelake.contract import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL and not set(ORACLES) & WITHOUT_SQL
    for name, query in QUERIES.items():
        df = query(spark, SF)
        columns = sorted(df.columns)
        if name in WITHOUT_SQL:
            assert df.count() > 0, name
            continue
        cur = con.execute(ORACLES[name])
        have = [d[0] for d in cur.description]
        want = [tuple(r[have.index(c)] for c in columns) for r in cur.fetchall()]
        assert rows([tuple(r[c] for c in columns) for r in df.collect()]) == rows(want), name


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'car' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
