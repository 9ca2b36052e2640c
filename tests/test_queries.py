"""Every query with an SQL form gives the rows that DuckDB gives on the smallest tables."""

import pytest

from counterpoise.oracles import ORACLE_SQL
from counterpoise.queries import QUERIES

from oracle import same


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, name):
    same(QUERIES[name](spark, small), ORACLE_SQL[name], small)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The engine's own queries stay registered if the optional folders and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/counterpoise", tmp_path / "counterpoise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == sorted(QUERIES)
