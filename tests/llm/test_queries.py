"""The training-data queries against their SQL; what is registered."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from trawl.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries()) and set(Q.ORACLE) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SF), name, Q.QUERIES[name], Q.ORACLE[name], SF)
    assert res["ok"], res
