"""Pairs inside keys are made by as many tasks as the pairs need, however few rows make them."""

from itertools import combinations

from reprise.operators import skew


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 1000, raising=False)
    rows = [("a", i) for i in range(300)] + [("b", i) for i in range(5)] + [("c", 1)]
    found = skew.within_key_pairs(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", [], block=20)
    got = sorted((r["k"], r["a"]["o"], r["b"]["o"]) for r in found.collect())
    assert got == sorted([("a", *p) for p in combinations(range(300), 2)] + [("b", *p) for p in combinations(range(5), 2)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 45), REPARTITION_BY_NUM" in plan
