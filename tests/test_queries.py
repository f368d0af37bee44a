"""Every registered query against its check statement on the smallest tables."""

import pytest

from oracle_check import compare
from pitsignal.plans.registry import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


def test_every_check_belongs_to_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_check(spark, name):
    assert compare(spark, SF, name) is None
