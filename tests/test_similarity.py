import random

import pytest
from pyspark.sql import functions as F

from reprise.operators import clusters, hamming, rollups


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_values(seed, centres, around, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(around):
            v = c
            for b in rng.sample(range(64), rng.randrange(0, flips + 1)):
                v ^= 1 << b
            out.add(v)
    return sorted(signed(x) for x in out)


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "phash long")


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6, 8, 11])
@pytest.mark.parametrize("hot", [4, 4096])
def test_join_equals_brute_force(spark, radius, hot):
    values = near_values(radius, 40, 12, 6)
    want = sorted((a, b, distance(a, b)) for i, a in enumerate(values) for b in values[i + 1:] if distance(a, b) <= radius)
    got = hamming.near_hashes(frame(spark, values), radius, hot=hot).collect()
    assert sorted(map(tuple, got)) == want


def test_crowded_block_values(spark):
    """Hashes that agree on most blocks, so nearly all share their keys."""
    rng = random.Random(1)
    values = sorted({rng.getrandbits(12) << rng.choice((0, 20, 40)) for _ in range(300)})
    want = sum(distance(a, b) <= 2 for i, a in enumerate(values) for b in values[i + 1:])
    assert hamming.near_hashes(frame(spark, values), 2, hot=10).count() == want


def sequential_linkage(items, radius):
    """The greedy rule, one pick at a time. items: (digest, hash), sorted by digest."""
    left, out = sorted(items), []
    while left:
        degree = [sum(distance(h, g) <= radius for _, g in left) for _, h in left]
        seed = left[degree.index(max(degree))]
        group = [seed]
        for item in left:
            if item != seed and all(distance(item[1], g) <= radius for _, g in group):
                group.append(item)
        out.append(frozenset(d for d, _ in group))
        left = [x for x in left if x not in group]
    return set(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    values = near_values(seed, 12, 14, 3)
    items = sorted((f"{rng.getrandbits(128):032x}", v) for v in values + rng.sample(values, len(values) // 3))
    contents = spark.createDataFrame(items, "sha256 string, phash long")
    classes = contents.select("sha256", F.lit("foto").alias("classe"))
    got = {}
    for row in clusters.mixed_clusters(contents, classes).collect():
        got.setdefault(row["cluster"], set()).add(row["sha256"])
    assert {frozenset(g) for g in got.values()} == sequential_linkage(items, 2)
    hashes = dict(items)
    assert all(distance(hashes[a], hashes[b]) <= 2 for g in got.values() for a in g for b in g)
    assert all(label == min(g) for label, g in got.items())


def test_linkage_golden_and_class_filter(spark):
    a, b, c = 0, 0b11, 0b1111
    contents = spark.createDataFrame([("a", a), ("b", b), ("c", c), ("d", 1)], "sha256 string, phash long")
    classes = spark.createDataFrame([("a", "foto"), ("b", "foto"), ("c", "foto"), ("d", "logo")], "sha256 string, classe string")
    got = {r["sha256"]: r["cluster"] for r in clusters.mixed_clusters(contents, classes).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(1, 2), (3, 4), (2, 4), (9, 8), (7, 7)], []])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        lo, hi = sorted((root(u), root(v)))
        parent[hi] = lo
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = clusters.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == want


def test_rollups_equal_listed_pairs(spark):
    """A school under several suppliers and images sharing a hash: the counts must still equal the listed pairs."""
    rng = random.Random(4)
    rows = []
    for i in range(90):
        image = rng.randrange(12)
        rows.append((i, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice("AB"), "UF", f"f{rng.randrange(6)}.pdf",
                     rng.randrange(1, 4), f"s{image:02d}", [0, 0, 1, 3, 7, 1 << 40, 1 << 41, 5 << 50][image % 8]))
    occ = spark.createDataFrame(
        rows, "occ_id long, inep long, fornecedor string, uf string, pdf_filename string, pagina int, sha256 string, phash long")
    edges = hamming.near_hashes(occ, 2)
    exact, visual = {}, []
    ordered = sorted(rows, key=lambda r: (r[4], r[5], r[0]))
    first = {}
    for r in ordered:
        if r[1]:
            first.setdefault((r[6], r[1]), r)
    for a in first.values():
        for b in first.values():
            if a[6] == b[6] and a[1] < b[1]:
                exact[a[6], a[1], b[1]] = (a, b)
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[6] != b[6] and distance(a[7], b[7]) <= 2 and a[1] and b[1] and a[1] != b[1]:
                visual.append((a, b))
    want = {}
    for kind, found in (("exact_pairs", exact.values()), ("visual_pairs", visual)):
        for a, b in found:
            for f in {a[2], b[2]}:
                w = want.setdefault(f, {"exact_pairs": 0, "visual_pairs": 0, "ineps": set()})
                w[kind] += 1
                w["ineps"] |= {a[1], b[1]}
    got = {r["fornecedor"]: r for r in rollups.supplier_rollup(occ, edges).collect()}
    assert {f: (r["exact_pairs"], r["visual_pairs"], r["affected_ineps_count"]) for f, r in got.items()} == {
        f: (w["exact_pairs"], w["visual_pairs"], len(w["ineps"])) for f, w in want.items()}
    sides, pdfs = {}, {}
    for a, b in [*exact.values(), *visual]:
        for x in (a, b):
            sides[x[1]] = sides.get(x[1], 0) + 1
            pdfs.setdefault(x[1], set()).add(x[4])
    schools = {r["inep"]: r for r in rollups.affected_schools(occ, edges).collect()}
    assert {i: (r["duplicate_count"], r["pdfs_count"]) for i, r in schools.items()} == {
        i: (n, len(pdfs[i])) for i, n in sides.items()}


def test_difference_hash_sees_the_whole_raster(spark):
    from reprise.operators import rasters

    ramp = [c for _ in range(32) for c in range(32)]
    lower = [c if r < 28 else 31 - c for r in range(32) for c in range(32)]
    df = spark.createDataFrame([(1, ramp), (2, lower), (3, ramp[::-1])], "k int, raster array<int>")
    got = {r["k"]: r["d"] for r in df.select("k", rasters.difference_hash(F.col("raster")).alias("d")).collect()}
    assert got == {1: -1, 2: -256, 3: 0}
