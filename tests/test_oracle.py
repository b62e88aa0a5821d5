"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, SF) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["errors"] == 0 for r in rows)
    assert all(r["content"].startswith("# ") for r in rows)
