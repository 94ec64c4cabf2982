import pytest
from pyspark.sql import functions as F

from reprise.functions import text
from reprise.operators import cases, groups, pairs

SCHEMA = ("occ_id long, inep long, fornecedor string, sha256 string, uf string, fase string, pdf_filename string, "
          "pdf_url string, pagina int, width int, height int, thumb_url string, phash long")


def occurrences(spark, rows):
    """rows: (inep, supplier[, sha])"""
    full = [(i, r[0], r[1], r[2] if len(r) > 2 else "s", "AC", "5", f"{r[0]} - AC - MUN - ESC - T.pdf", f"u{i}.pdf", 1, 1600, 1200,
             f"t{i}.jpg", 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize("rows,supplier", [
    ([(1, "A"), (1, "A")], None),
    ([(1, "A (RI) / B (RE)"), (2, "A (RI) / C (RE)")], "A"),
    ([(1, "A"), (2, "B")], None),
    ([(1, "A"), (1, "B"), (2, "B")], "B"),
    ([(1, text.UNKNOWN_SUPPLIER), (2, text.UNKNOWN_SUPPLIER)], text.UNKNOWN_SUPPLIER),
    ([(None, "A"), (0, "A"), (2, "A")], None),
    ([(1, "A (RI) / B (RE)"), (2, "B (RI) / A (RE)"), (None, "Z")], "A / B"),
    ([(1, "A"), (2, ""), (3, "A")], None),
])
def test_common_supplier_rule(spark, rows, supplier):
    got = groups.group_summary(occurrences(spark, rows)).collect()
    assert [r["fornecedor"] for r in got] == ([] if supplier is None else [supplier])
    if supplier:
        assert got[0]["qtd_ocorrencias"] == len(rows)


def test_templates_and_switches(spark):
    occ = occurrences(spark, [(1, "A"), (2, "B"), (1, "A", "t"), (2, "A", "t")])
    assert [r["sha256"] for r in groups.template_clusters(occ).collect()] == ["s"]
    assert groups.group_summary(occ, same_supplier=False).count() == 1
    everything = groups.group_summary(occ, same_supplier=False, ignore_templates=False).orderBy("grupo_seq").collect()
    assert [(r["cluster"], r["fornecedor"], r["grupo_id"]) for r in everything] == [("s", "", "G00001"), ("t", "A", "G00002")]


def test_chain_counts_the_unknown_school(spark):
    occ = occurrences(spark, [(3, "A"), (None, "A"), (1, "A"), (2, "A"), (2, "A")])
    members = groups.members(occ, groups.group_summary(occ))
    chain = pairs.chain_pairs(members).collect()
    assert sorted((r["inep_a"] or 0, r["inep_b"]) for r in chain) == [(0, 1), (1, 2), (2, 3)]
    classes = spark.createDataFrame([], "sha256 string, classe string")
    found = cases.case_images(members, classes).select("inep_a", "inep_b", "classe").collect()
    assert sorted(map(tuple, found)) == [(1, 2, "indefinido"), (1, 3, "indefinido"), (2, 3, "indefinido")]


def test_counterparts_last_group_wins(spark):
    occ = occurrences(spark, [(1, "A"), (2, "A"), (3, "A"), (1, "A", "t"), (2, "A", "t")])
    members = groups.members(occ, groups.group_summary(occ))
    other = pairs.counterparts(members)
    audited = pairs.audited_rows(occ, members)
    nested = {r["occ_id"]: r for r in pairs.nest_counterparts(audited, other).collect()}
    assert [d["outro_inep"] for d in nested[0]["duplicada_com"]] == [2, 3]
    assert all(r["tem_duplicata"] for r in nested.values())


def case_frame(spark):
    occ = occurrences(spark, [(1, "A"), (2, "A"), (3, "A", "t"), (2, "A", "t")])
    members = groups.members(occ, groups.group_summary(occ))
    rows = cases.case_images(members, spark.createDataFrame([("s", "foto"), ("t", "logo")], "sha256 string, classe string"))
    geo = spark.createDataFrame([("u0.pdf", 2, 5, 80.0)], "pdf_url string, fora_do_raio long, com_coordenada long, distancia_max_m double")
    marks = spark.createDataFrame(
        [("1x2", True, False, "outro", "x", "2026-01-01")],
        "par_id string, falso_positivo boolean, mae_filho boolean, motivo_codigo string, motivo string, marcado_em string")
    sent = spark.createDataFrame([("9x3", 9, 3)], "par_id string, inep_a long, inep_b long")
    return cases.case_table(rows, cases.case_pdfs(rows, geo), marks, sent)


def test_case_facts_and_filters(spark):
    table = case_frame(spark).cache()
    by_id = {r["par_id"]: r for r in table.collect()}
    assert set(by_id) == {"1x2", "2x3"}
    one, two = by_id["1x2"], by_id["2x3"]
    assert (one["qtd_evidencias"], one["fora_do_raio"], one["distancia_max_m"], one["falso_positivo"]) == (1, 2, 80.0, True)
    assert (two["so_material_comum"], two["ja_encaminhado"], one["ja_encaminhado"]) == (True, True, False)
    assert one["mesmo_municipio"] and one["mesma_uf"] and not one["mesmo_pdf"]
    for options, kept in [
        ({}, 2), ({"evidencia": "com_foto"}, 1), ({"gravidade": "fora_do_raio"}, 1), ({"falso_positivo": "ocultar"}, 1),
        ({"encaminhado": "somente"}, 1), ({"min_imagens": "x"}, 2), ({"min_imagens": 2}, 0), ({"busca": " ESC "}, 2),
        ({"uf": "ac"}, 2), ({"fornecedor": "b"}, 0), ({"contem": "3 - ac"}, 1), ({"tipo": "visuais"}, 0),
    ]:
        assert cases.filter_cases(table, **options).count() == kept, options
    total = cases.case_summary(table).first()
    assert (total["pares"], total["escolas"], total["pendentes"], total["fora_do_raio"]) == (2, 3, 1, 1)
    assert [tuple(r) for r in cases.cases_by_state(table).collect()] == [("AC", 4)]
    page = pairs.with_total(pairs.page_slice(table, cases.case_order(), page=2, limit=1), table).collect()
    assert [(r["par_id"], r["total"]) for r in page] == [("2x3", 2)]
    table.unpersist()


def test_group_search(spark):
    occ = occurrences(spark, [(1, "A"), (2, "A"), (3, "B", "t"), (4, "B", "t")])
    g = groups.group_summary(occ)
    nested = groups.nest_groups(groups.members(occ, g))
    assert groups.filter_groups(g, nested, search="4 b").count() == 1
    assert groups.filter_groups(g, nested, min_schools=3).count() == 0


def test_pair_filters(spark):
    occ = occurrences(spark, [(1, "Alfa"), (2, "Beta"), (3, "Alfa")])
    found = pairs.exact_school_pairs(occ)
    assert found.count() == 3
    assert pairs.filter_pairs(found, search="beta").count() == 2
    assert pairs.filter_pairs(found, kind="visual").count() == 0
    assert pairs.filter_pairs_by_supplier(found, "ALFA").count() == 3
    rows = pairs.audited_rows(occ, groups.members(occ, groups.group_summary(occ)))
    assert pairs.filter_audited(rows, duplicate="false", search="3").count() == 1
    flagged = pairs.flag_by_id_or_image(
        occ.withColumn("scan_id", F.col("occ_id").cast("string")),
        spark.createDataFrame([("0", "zzz")], "scan_id string, sha256 string"))
    assert flagged.where("tem_duplicata").count() == 1
