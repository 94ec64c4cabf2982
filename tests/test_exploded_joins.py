"""Rows exploded to many keys are joined by a shuffle, however small the table below looks."""

import pytest

from reprise.operators import hamming, neighbours, skew
from reprise.session import materialise


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [2, 8])
def test_probes_are_not_broadcast(spark, radius):
    values = materialise(spark.createDataFrame([(i * 37, 1) for i in range(200)], "phash long, n long"), "values")
    for found in (hamming.near_hashes(values, radius), neighbours.sums(values, [], radius), neighbours.links(values, radius)):
        assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)


def test_links_in_files_are_not_broadcast(spark):
    edges = materialise(spark.createDataFrame([(i, i + 1, 3) for i in range(200)], "a long, b long, d int"), "edges")
    left, right = (materialise(spark.createDataFrame([(i, i) for i in range(201)], f"{k} long, {v} long"), "rows") for k, v in ("ax", "by"))
    found = skew.across_key_pairs(edges, left, right, "a", "b")
    assert sorted((r.x, r.y, r.d) for r in found.collect()) == [(i, i + 1, 3) for i in range(200)]
    assert plan(skew.across_key_pairs(edges, left, right, "a", "b")).count("SortMergeJoin") >= 3
