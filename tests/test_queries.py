"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from caseloom.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, difference

NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_investigation_end_to_end(spark, sf_dir):
    rows = QUERIES["investigations"](spark, sf_dir).collect()
    assert rows and all(r.confidence in ("low", "medium", "high") and r.answer for r in rows)
