"""Hits are dealt out once and unsorted, and families' volumes come from one pass over the detections."""

import re

from vaultlens.operators import aggregate
from vaultlens.operators.detect import deduplicate
from vaultlens.plans.registry import made_hits

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_not_merged_before_they_are_dealt_out(spark):
    plan = plan_of(deduplicate(made_hits(spark, SF), ("confidence",)))
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "Aggregate" not in below and "detector_id" not in below


def test_families_read_hits_once(spark):
    plan = plan_of(aggregate.family_summary(deduplicate(made_hits(spark, SF), ("confidence", "validation"))))
    assert len(re.findall("FileScan", plan)) == 1 and "Join" not in plan


def test_family_edges(spark):
    schema = "file_id string, family string, confidence string, validation string, value_hash string, occurrences bigint, location_hints array<string>"
    rows = [
        ("a", "ordinary", "high", "valid", "x", 2, ["p", "q"]), ("a", "ordinary", "high", "valid", "x", 3, ["p", None]), ("a", "ordinary", "low", "valid", "z", 9, ["r"]),
        ("a", "ordinary", "medium", "valid", None, 1, None), ("a", "ordinary", "medium", "valid", "", 1, []), ("b", "payment", "high", "valid", None, 4, None),
    ]
    got = {tuple(r) for r in aggregate.family_summary(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "ordinary", 7, 1, 2), ("b", "payment", 4, 0, 0)}
