"""Every registered query against its checking SQL at the smallest scale; the corpus operators have their own tests."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, database

FOLDER = "/root/testdata/sf0.001"
NAMES = [name for name in entry.queries() if not (entry.corpus and (name in entry.corpus.QUERIES or name == "pipeline"))]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    result = compare(spark, connection, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_checking_query_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries())
