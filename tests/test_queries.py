"""Every registered query against its checker SQL on the smallest tables."""

import pytest

from feedloom.plans.catalog import CHECKS, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok, message


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(CHECKS) == {"compressed_notes", "deduped_bullets", "communities"}
