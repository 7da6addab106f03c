"""Each registered query on the smallest tables, against its SQL where it has one."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
import __spark_entry__ as entry  # noqa: E402
from compare import compare, views  # noqa: E402
from knotwork import plans  # noqa: E402

NAMES = [n for m in plans.modules() for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    views(c, folder)
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    said = compare(spark, con, name, folder)
    assert ": ok," in said or "no oracle" in said, said


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
