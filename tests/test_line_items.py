"""Line items are not combined by part in their scan, where one task would hold nearly every row of its split."""

from __future__ import annotations

import os

import pytest

from concourse.plans import bindings as b
from concourse.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_line_items_meet_part_before_they_combine(spark):
    plan = b.nav_edges(Tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not any("l_partkey" in line for line in groups)
