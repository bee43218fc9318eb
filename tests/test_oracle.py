"""Registered queries against their SQL in DuckDB on the smallest given tables.

Every query is compared by tools/check.py; this is the quick selection (NETWEIR_ORACLE=all runs all of them).
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = ("TOP-01", "TOP-03", "TOP-13", "TOP-16", "ROL-01", "ROL-06", "ROL-12", "SER-11", "SER-15", "SER-16", "PCT-04", "CAP-01", "CAP-09",
         "HEA-02", "CHG-02", "CHG-08", "FLW-01", "ALR-01", "ALR-12", "ALR-17", "ALR-18", "ALR-28", "CFG", "RET", "REP-01", "JON-03", "SRC-05", "SRC-12")
NAMES = [n for n in oracle_sql() if os.environ.get("NETWEIR_ORACLE") == "all" or n.startswith(QUICK)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
