"""Every registered query of the library against its DuckDB twin on sf0.001; the flagship entry runs."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from trawl.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert res.get("ok") in (True, None), res


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["keyword", "url", "depth", "para_idx", "text"]
    assert df.count() > 0
