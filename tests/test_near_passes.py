"""How often the rollups shuffle hashes under their keys, and that nothing they wrote is broadcast by the size of its file."""

import pytest

from reprise.operators import neighbours, rollups

COLUMNS = "occ_id long, inep long, fornecedor string, uf string, pdf_filename string, pagina int, sha256 string, phash long"
BUILD = {"supplier_rollup": (rollups.supplier_rollup, 4), "affected_schools": (rollups.affected_schools, 2), "scan_totals": (rollups.scan_totals, 2),
         "school_sides": (lambda occ, radius: rollups.school_sides(occ, occ, radius), 2)}


@pytest.mark.parametrize("name", BUILD)
def test_few_passes_without_broadcasts(spark, monkeypatch, name):
    build, most = BUILD[name]
    rows = [(i, i % 4, "ABC"[i % 3], "BA", f"f{i % 5}.pdf", 1, f"s{i % 11}", (i % 11) * 5) for i in range(60)]
    occ = spark.createDataFrame(rows, COLUMNS)
    keyed, passes = neighbours._keyed, []
    monkeypatch.setattr(neighbours, "_keyed", lambda *args: passes.append(1) or keyed(*args))
    found = build(occ, 8)
    assert len(passes) <= most
    if name in ("affected_schools", "school_sides"):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_suppliers_of_a_hash_are_counted_once(spark):
    """A hash that several suppliers hold meets each occurrence on its neighbour once."""
    rows = [(0, "A", 1, 1, 2), (0, "B", 2, 3, 1), (1, "A", 4, 4, 5), (1 << 40, "C", 7, 7, 1)]
    frame = spark.createDataFrame(rows, "phash long, fornecedor string, lo long, hi long, n long")
    for block in (1000, 1):
        got = {(r.phash, r.fornecedor): (r.lo, r.hi, r.near) for r in neighbours.reach(frame, "fornecedor", 2, block).collect()}
        near = {0: [1, 1 << 40], 1: [0, 1 << 40], 1 << 40: [0, 1]}  # all within two bits
        want = {}
        for h, others in near.items():
            for g, t, lo, hi, n in rows:
                if g in others:
                    old = want.get((h, t), (lo, hi, 0))
                    want[h, t] = min(lo, old[0]), max(hi, old[1]), n + old[2]
        assert got == want
