import inspect
import os
import subprocess
import sys

import pytest

from heartlake.catalog.core import catalog
from tests.oracle import differences


@pytest.mark.parametrize("part", ["matrices", "scores", "listings", "tables", "signals"])
def test_queries_agree_with_sql(spark, small, part):
    import importlib

    own = importlib.import_module(f"heartlake.catalog.{part}").catalog
    assert differences(own, spark, small) == {}


def test_queries_without_sql_run(spark, small):
    for name in set(catalog.queries) - set(catalog.sql):
        df = catalog.queries[name](spark, small)
        assert df.columns and df.count() >= 0, name


def test_every_query_says_what_it_gives():
    assert all(inspect.getdoc(f) for f in catalog.queries.values())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.queries) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 6


def test_entry_points_without_a_dependency_of_the_subpackage():
    """In a process of its own: with a library missing that only the subpackage needs, the core queries stay."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; from heartlake.catalog.core import catalog as c; assert set(e.queries()) == set(c.queries) and set(e.oracle_sql()) == set(c.sql)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
