"""Supplier scans and reports with visual pairs, against listed pairs."""

import random

from reprise.operators import hamming, pairs, rollups

COLUMNS = "occ_id long, inep long, fornecedor string, uf string, pdf_filename string, pagina int, sha256 string, phash long"


def test_supplier_scans_count_visual_pairs(spark):
    rng = random.Random(8)
    names = ["Alfa", "Beta", "Alfa Sul"]
    fields = ["Alfa (RI) / Beta (RE)", "Beta", "Alfa Sul (RE)", "Alfa", None]
    hashes = [0, 0, 1, 3, 7, 1 << 40, 1 << 41, 5 << 50]
    rows = []
    for i in range(120):
        image = rng.randrange(16)
        rows.append((i, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(fields), "UF", f"f{i % 6}.pdf", 1, f"s{image:02d}", hashes[image % 8]))
    occ = spark.createDataFrame(rows, COLUMNS)
    edges = hamming.near_hashes(occ, 2)
    totals, first = {}, {}
    for name in sorted(names):
        own = [r for r in rows if r[2] and name.lower() in r[2].lower()]
        exact = {(a[6], a[1], b[1]) for a in own for b in own if a[6] == b[6] and a[1] and b[1] and a[1] < b[1]}
        visual = [(a[1], b[1]) for k, a in enumerate(own) for b in own[k + 1:]
                  if a[6] != b[6] and (a[7] ^ b[7]).bit_count() <= 2 and a[1] and b[1] and a[1] != b[1]]
        sides = [s for _, a, b in exact for s in (a, b)] + [s for p in visual for s in p]
        totals[name] = (len(own), len(exact), len(visual), len(exact) + len(visual), len(set(sides)))
        for s in set(sides):
            first.setdefault(s, (name, sides.count(s)))
    assert all(t[2] > 0 for t in totals.values())
    got = rollups.all_supplier_totals_visual(occ, occ, occ, edges).collect()
    assert {r.nome: (r.imagens, r.exact_pairs, r.visual_pairs, r.pares, r.escolas_afetadas) for r in got} == totals
    got = rollups.accumulated_schools_visual(occ, occ, occ, edges).collect()
    assert {r.inep: (r.fornecedor, r.duplicate_count) for r in got} == first


def test_visual_pairs_keep_more_columns(spark):
    occ = spark.createDataFrame([(1, 1, "A", "BA", "a.pdf", 1, "x", 0), (2, 2, "B", "MA", "b.pdf", 2, "y", 1)], COLUMNS)
    got = pairs.visual_pairs(occ, hamming.near_hashes(occ, 2), more=("uf", "fornecedor")).collect()
    assert [(r.uf_a, r.fornecedor_a, r.uf_b, r.fornecedor_b, r.similaridade) for r in got] == [("BA", "A", "MA", "B", 98.4)]


def test_names_by_automaton_and_by_pieces(spark):
    names = ["Alfa", "alfa", "Alfa Sul", "ß-Net", "Ünião", "a", "", None, "Não existe", "(RI)"]
    fields = ["Alfa (RI) / Beta (RE)", "ALFA SUL", "xx", "ÜNIÃO & ß-net", "", None, "alfa alfa"]
    frame = lambda vs, c: spark.createDataFrame([(v,) for v in vs], f"{c} string")
    fast = rollups.name_matches(frame(fields, "fornecedor"), frame(names, "nome"))
    slow = rollups.name_matches(frame(fields, "fornecedor"), frame(names, "nome"), most=0)
    want = sorted((f, n) for f in fields if f for n in names if n and n.lower() in f.lower())
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) == want
    assert "__lower" not in fast.columns and rollups.name_matches(frame(fields, "fornecedor"), frame([], "nome")).collect() == []


def test_report_counts_match_listed_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["A", "B", None]), rng.choice(["BA", "MA", None]), f"f{i}.pdf", 1, f"s{rng.randrange(9)}", 0) for i in range(90)]
    rows = [(*r[:7], [0, 1, 3, 1 << 30, 7, 1 << 31, 0, 5 << 40, 1 << 50][int(r[6][1])]) for r in rows]
    occ = spark.createDataFrame(rows, COLUMNS)
    edges = hamming.near_hashes(occ, 2)
    listed = pairs.exact_school_pairs(occ.withColumn("thumb_url", occ.sha256)).select("inep_a", "inep_b", "uf_a", "uf_b", "fornecedor_a", "fornecedor_b").collect()
    visual = pairs.visual_pairs(occ, edges, more=("uf", "fornecedor")).select("inep_a", "inep_b", "uf_a", "uf_b", "fornecedor_a", "fornecedor_b").collect()
    totals = rollups.school_pair_totals(occ, occ, 2).first()
    assert (totals.exatos, totals.visuais) == (len(listed), len(visual)) and len(visual) > 20
    sides = {}
    for r in [*listed, *visual]:
        for s in "ab":
            sides.setdefault(r[f"inep_{s}"], []).append((r[f"uf_{s}"], r[f"fornecedor_{s}"]))
    got = {r.inep: (r.uf, r.fornecedor, r["count"]) for r in rollups.school_sides(occ, occ, 2).collect()}
    least = lambda vs: min((v for v in vs if v is not None), default=None)
    assert got == {i: (least(u for u, _ in v), least(f for _, f in v), len(v)) for i, v in sides.items()}
