"""Shallot search against full search."""

import hashlib

import numpy as np
import pytest

from reprise.llm import shallot

ROWS = "vec_id long, embedding array<double>, cluster int, v string, block long, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7, "x", 1, "y") for i, v in rows], ROWS)


def brute(rows, dim, k, rounds):
    """Python integers, every centroid measured."""
    limit = 1 << 62
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            x = [float(x) * 1024 for x in v]
            kept.append((i, [max(-limit, min(limit, int(np.floor(y)) if np.isfinite(y) else int(np.sign(y)) * limit)) for y in x], [float(x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2]))
    c = [r[1] for r in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), j) for j, p in enumerate(c))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x, _ in kept]
        c = [[sum(col) // len(col) for col in zip(*[x for (_, x, _), o in zip(kept, own) if o == j])] if j in own else p for j, p in enumerate(c)]
    last = [nearest(x) for _, x, _ in kept]
    top = shallot.LARGEST
    by = [min(top, sum(min(top, d) for d, j in last if j == n)) for n in range(len(c))]
    every = min(top, sum(min(top, d) for d, _ in last))
    return sorted(((i, j, min(top, d), by[j], every, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _, _), (d, j) in zip(kept, last)), key=repr)


def collected(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 2, 8])
def test_clusters(spark, k):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 4))
    rows = [(i, centre[i % 6] + 0.4 * rng.standard_normal(4)) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]  # copies
    rows += [(2000 + i, rng.integers(-1, 2, 4)) for i in range(80)]  # ties
    rows += [(3, centre[0]), (3, centre[1]), (None, centre[2]), (None, centre[2])]
    rows += [(5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0, None, 1.0, 1.0]), (5004, [float("nan")] * 4), (5005, [1.0, float("inf"), 1.0, 1.0])]
    got = shallot.cluster(frame(spark, rows).repartition(5), k=k, dim=4, rounds=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert collected(got) == brute(rows, 4, k, 5)


def test_wide_numbers_and_few_vectors(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e18, 3.0]), (3, [3e7, -3e7]), (4, [0.25, 0.75]), (5, [3e7, -3e7 + 1])]
    assert collected(shallot.cluster(frame(spark, rows), dim=2, rounds=3)) == brute(rows, 2, 8, 3)
    assert collected(shallot.cluster(frame(spark, rows), dim=2, rounds=3, k=2)) == brute(rows, 2, 2, 3)


def test_empty_tables(spark):
    assert shallot.cluster(frame(spark, [])).collect() == shallot.cluster(frame(spark, [(1, None)])).collect() == []


def test_search_skips_most_distances():
    rng = np.random.default_rng(5)
    centre = 900 * rng.standard_normal((40, 8))
    x = shallot.integers(centre[rng.integers(0, 40, 4000)] + 60 * rng.standard_normal((4000, 8)), 1)
    old = shallot.Centroids([p.astype(int).tolist() for p in centre])
    bounds = shallot.Bounds.unknown(len(x), 40)
    assert shallot.assign(x, old, bounds) < 40 * len(x)  # nothing is known yet
    for _ in range(4):
        full = ((x[:, None, :] - old.array[None]) ** 2).sum(axis=2)
        assert (bounds.near == full.argmin(axis=1)).all()
        assert (bounds.upper * (1 + 1e-9) >= np.sqrt(full.min(axis=1))).all()
        assert (bounds.lower * (1 - 1e-9) <= np.sqrt(np.sort(full, axis=1)[:, 1])).all()
        old = shallot.Centroids([(x[bounds.near == j].sum(axis=0) // max(1, (bounds.near == j).sum())).tolist() if (bounds.near == j).any() else p
                                 for j, p in enumerate(old.points)], old)
        assert shallot.assign(x, old, bounds) < 0.2 * 40 * len(x)
    again = shallot.Bounds.read(bounds.bytes())
    assert all((getattr(again, c) == getattr(bounds, c)).all() for c in ("near", "second", "upper", "lower"))


def test_rounds_do_not_shuffle_the_vectors(spark, sf_dir):
    tables = shallot._Tables(spark)
    kept = shallot.kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64)
    points = tables.write(shallot._blocks(kept, 64, 1024).repartition(tables.buckets, "block"), "points")
    joined = points.join(points.select("block", "points").hint("shuffle_hash").withColumnRenamed("points", "bounds"), "block")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    tables.forget()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
