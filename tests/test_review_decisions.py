"""Decisions on candidates are judged without publishing anything."""

import os

import pytest

from reefline.operators import lifecycle
from reefline.plans import catalog
from reefline.plans.fixtures import Fixtures

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_judging_does_not_submit(spark, monkeypatch):
    def submit(*_):
        raise AssertionError("a batch of submissions was walked")
    monkeypatch.setattr(lifecycle, "submit", submit)
    fx = Fixtures(spark, SF_DIR)
    judged = catalog.run("I11_candidate_decisions", fx)
    asked = fx.sql("SELECT count(*) + count(CASE WHEN incident_id % 10 = 1 THEN 1 END) AS n FROM decisions_v").first()["n"]
    assert judged.count() == asked
