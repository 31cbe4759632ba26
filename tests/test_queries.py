"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.compare import compare, duck
from workload import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_a_check():
    assert [n for n, (_, sql) in catalog().items() if sql is None] == []
