"""Every registered query against its SQL on the smallest given tables (SF_DIR names others)."""

import os

import pytest

from tests.compare import connect, difference
from tillmark.registered import oracles, runners

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NAMES = list(runners())


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    frame = runners()[name](spark, SF_DIR)
    if name in oracles():
        assert difference(frame, db, oracles()[name]) is None
    else:
        assert frame.count() >= 0


def test_every_sql_has_a_query():
    assert set(oracles()) <= set(runners())
