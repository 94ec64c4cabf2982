"""Sums over neighbouring hashes against listed pairs, with crowded keys, and without a row per pair."""

import random

import pytest

from reprise.operators import clusters, hamming, neighbours, rollups


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def values(seed, n=400):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        v = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            v ^= 1 << b
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 8])
@pytest.mark.parametrize("block", [1000, 7])
def test_sums_links_and_distances(spark, radius, block):
    vals = values(radius)
    rng = random.Random(1)
    n = {v: rng.randint(1, 5) for v in vals}
    frame = spark.createDataFrame([(signed(v), n[v]) for v in vals], "phash long, n long")
    near = {v: sum(n[w] for w in vals if 1 <= (v ^ w).bit_count() <= radius) for v in vals}
    got = {r.phash: r.near for r in neighbours.sums(frame, [], radius, block).collect()}
    assert got == {signed(v): s for v, s in near.items() if s}
    links = neighbours.links(frame, radius, block)
    rows = links.count()
    assert rows <= 70 * len(vals)
    label = {r.node: r.component for r in clusters.connected_components(links, "phash_a", "phash_b").collect()}
    want = {}
    for v in vals:
        want[v] = v
    changed = True
    while changed:
        changed = False
        for v in vals:
            low = min((want[w] for w in vals if (v ^ w).bit_count() <= radius), key=signed)
            if signed(low) < signed(want[v]):
                want[v], changed = low, True
    assert {signed(v): signed(c) for v, c in want.items() if near[v]} == label
    if block == 1000:
        listed = hamming.distance_counts(spark.createDataFrame([(f"{v:x}-{i}", signed(v)) for v in vals for i in range(n[v])], "sha256 string, phash long"),
                                         hamming.near_hashes(frame, radius))
        assert sorted(map(tuple, neighbours.distances(frame, radius).collect())) == sorted(map(tuple, listed.collect()))


@pytest.mark.parametrize("radius", [2, 8])
def test_rollups_agree_with_listed_pairs(spark, radius):
    rng = random.Random(4)
    vals = values(9, 60)
    rows = [(i, rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice(["Alfa (RI) / Beta (RE)", "Beta", "Alfa", None, ""]), rng.choice(["BA", None]), f"f{i % 9}.pdf", i % 3,
             f"s{v:x}{i % 2}", signed(v)) for i in range(300) for v in [rng.choice(vals)]]
    occ = spark.createDataFrame(rows, "occ_id long, inep long, fornecedor string, uf string, pdf_filename string, pagina int, sha256 string, phash long")
    edges = hamming.near_hashes(occ, radius)
    flat = lambda df: sorted(map(str, df.collect()))
    for build in (rollups.supplier_rollup, rollups.affected_schools, rollups.affected_files, rollups.scan_totals):
        assert flat(build(occ, radius)) == flat(build(occ, edges)), build.__name__
    for build in (rollups.all_supplier_totals_visual, rollups.accumulated_schools_visual):
        assert flat(build(occ, occ, occ, radius)) == flat(build(occ, occ, occ, edges)), build.__name__


def test_near_copies_stay_linear(spark):
    """Five thousand hashes within a small ball hold millions of pairs; what cells return stays below the rows they were given."""
    rng = random.Random(2)
    ball = set()
    while len(ball) < 5000:
        v = 0
        for b in rng.sample(range(20), rng.randint(0, 4)):
            v ^= 1 << b
        ball.add(v)
    frame = spark.createDataFrame([(v, 1) for v in sorted(ball)], "phash long, n long")
    cells = neighbours._cells(frame.select("phash", "n"), [], 2, neighbours.BLOCK)
    dealt = cells.count()
    links = neighbours.links(frame, 2).count()
    assert links <= dealt <= 6 * 5000 * 6
    pairs = sum(r.near for r in neighbours.sums(frame, [], 2).collect()) // 2
    assert pairs > 20 * 5000 and links < pairs
