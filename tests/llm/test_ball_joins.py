"""Joins of what was exploded: its real size is never the estimated one, so it must not be broadcast."""

import pytest
from pyspark.sql import functions as F

from vaultlens.llm import simhash


@pytest.mark.parametrize(("distance", "crowded"), [(2, 64), (2, 0), (1, 0), (3, 0)])
def test_balls_are_not_broadcast(spark, distance, crowded):
    simhash.use_shared_dir(spark)
    low = spark.range(40).select(F.col("id").bitwiseXOR(F.lit(7 << 32)).alias("fp"))
    fps = low.union(spark.range(40).select(F.xxhash64("id"))).distinct()
    found = simhash.links(fps, distance=distance, crowded=crowded)
    got = found.collect()
    assert got and all(r["u"] != r["v"] for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not any("BroadcastHashJoin" in line and "Inner" in line for line in plan.splitlines())
