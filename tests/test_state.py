"""Register, marks and ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reprise.operators import ledger, marks, recovery, register
from reprise.schemas import schema


def event(spark, *rows):
    full = [("r", "1x2", dt.datetime(2026, 1, 1, 0, i), i, *r) for i, r in enumerate(rows)]
    names = "run_id string, par_id string, ts timestamp, seq long, falso_positivo boolean, motivo_codigo string, motivo string, " \
            "mae_filho boolean, inep_a long, inep_b long, autor string"
    return spark.createDataFrame(full, names)


def test_mark_fold_keeps_and_clears(spark):
    steps = [(True, "outro", "porque", None, 1, 2, "ana"), (None, None, None, True, None, None, ""),
             (False, None, None, None, None, None, "bia")]
    kept = marks.current_marks(event(spark, *steps[:2])).first()
    assert (kept["falso_positivo"], kept["motivo_codigo"], kept["motivo"], kept["mae_filho"]) == (True, "outro", "porque", True)
    assert (kept["inep_a"], kept["atualizado_por"]) == (1, "ana")
    cleared = marks.current_marks(event(spark, *steps)).first()
    assert (cleared["falso_positivo"], cleared["motivo_codigo"], cleared["motivo"], cleared["mae_filho"]) == (False, None, None, True)
    rewritten = marks.current_marks(event(spark, *steps[:2], (False, "conferido_ok", None, None, None, None, ""))).first()
    assert (rewritten["motivo_codigo"], rewritten["motivo"]) == ("conferido_ok", None)


def test_mark_admission(spark):
    rows = event(spark, (True, "nada", None, None, 1, 2, ""), (None, "outro", None, None, 1, 2, ""), (True, "", None, None, 1, 2, ""))
    assert [r["seq"] for r in marks.accepted(rows).collect()] == [2]
    assert sorted(r["seq"] for r in marks.rejected(rows).collect()) == [0, 1]


def export(spark, *rows):
    cols = "INEP string, UF string, fornecedor_ri string, fornecedor_re string, FASE string, `Status Geral` string, Books string, " \
           "Atualizacao string, `Ativação Rede externa` string, `Ativação Rede interna` string"
    return register.typed_export(spark.createDataFrame(list(rows), cols))


def test_register_diff_and_idempotent_upsert(spark):
    current = spark.createDataFrame([
        ("k1", 1, "AC", "A", "RI", "Conectada", "5", ["https://h/a.pdf"], dt.datetime(2026, 1, 1), None, None),
        ("k2", 2, "AC", "A", "RI", "Conectada", "5", None, None, None, None),
        ("k3", 3, "AC", "A", "RI", "Conectada", "5", [], None, None, None),
        ("k0", None, "AC", "A", "RI", "Conectada", "5", [], None, None, None)], schema("register"))
    new = export(
        spark, ("1", "ac", "A", None, "5.0", " ", "//h/a.pdf", "2026-01-01 00:00:00", None, None),
        ("2.0", "AC", "A", "B", "4.1", "x", "", None, None, None), ("9", "MA", None, "B", "10", None, None, "ruim", None, None))
    diff = register.register_diff(new, current)
    got = {r["inep"]: (r["acao"], set(r["campos"]), r["escola_id_bubble"]) for r in diff.collect()}
    assert got == {
        1: ("igual", set(), "k1"), 2: ("alterado", {"fornecedor", "tipo_fornecedor", "status_geral", "fase"}, "k2"),
        3: ("orfao", set(), "k3"), 9: ("novo", set(), "inep_9")}
    sent = register.rows_to_send(diff)
    once = register.merged_register(current, sent)
    twice = register.merged_register(once, sent)
    flat = lambda df: sorted((tuple(r) for r in df.select("escola_id_bubble", "inep", "fornecedor", "fase").collect()), key=str)
    assert flat(once) == flat(twice) and once.count() == 5
    assert register.rows_to_send(diff, only_changes=False).count() == 3
    assert [r["fase"] for r in register.forbidden_phases(new, "5").orderBy("fase").collect()] == ["10", "4.1"]
    assert register.orphans(new, current).select("inep").first()["inep"] == 3


def test_register_duplicates_and_columns(spark):
    rows = export(spark, ("1", "AC", "A", None, "5", "x", None, "2026-01-01", None, None),
                  ("1", "AC", "B", None, "5", "x", None, "2026-01-02", None, None))
    assert register.one_per_school(rows, [F.col("atualizacao")]).first()["fornecedor"] == "B"
    without = export(spark, ("", "AC", "A", None, "5", "x", None, "2026-01-01", None, None), (None, "AC", "B", None, "5", "x", None, "2026-01-02", None, None))
    assert register.one_per_school(without, [F.col("atualizacao")]).count() == 0 and register.rejected_rows(without).count() == 2
    assert register.column_like(spark.createDataFrame([(1,)], "`Ativação Rede externa` int"), "rede EXTERNA")
    with pytest.raises(KeyError):
        register.column_like(rows, "nada")


def test_lot_sources_and_delete(spark):
    copy = lambda *r: spark.createDataFrame(list(r), "envio_id string, par_id string, snapshot string")
    lots = spark.createDataFrame([("a",), ("b",), ("c",)], "envio_id string")
    got = ledger.lot_evidence(lots, copy(("a", "1x2", "db")), copy(("a", "1x2", "disk"), ("b", "1x2", "disk")),
                              copy(("a", "3x4", "now"), ("b", "3x4", "now"), ("c", "3x4", "now"), ("z", "3x4", "now")))
    assert sorted((r["envio_id"], r["snapshot"]) for r in got.collect()) == [("a", "db"), ("b", "disk"), ("c", "now")]
    trail = spark.createDataFrame([("envio_criado", "a", None)], "tipo string, envio_id string, criado_em timestamp")
    kept = ledger.delete_lot(lots, copy(("a", "1x2", "")), copy(("a", "", "")), trail, "a", F.current_timestamp())
    assert [df.count() for df in kept] == [2, 0, 0, 2]


def test_first_source_and_runs(spark):
    runs = lambda *r: spark.createDataFrame(list(r), "run_id string, status string")
    both = ledger.first_source([runs(("a", "processando"), ("b", "processando")), runs(("a", "concluido"), ("c", "concluido"))], ["run_id"])
    got = {r["run_id"]: r["status"] for r in ledger.run_status(both, current_run="b").collect()}
    assert got == {"a": "interrompido", "b": "processando", "c": "concluido"}
    assert ledger.missing_runs(runs(("a", ""), ("d", "")), runs(("a", ""))).first()["run_id"] == "d"


def test_recovered_groups_and_urls(spark):
    fields = ["inep", "uf", "fornecedor", "pdf_filename", "pagina", "thumb_url"]
    ddl = "sha256 string, pair_seq long, " + ", ".join(
        f"{c}_{s} {'long' if c == 'inep' else 'int' if c == 'pagina' else 'string'}" for s in "ab" for c in fields)
    pairs = spark.createDataFrame([
        ("s", 1, 1, "AC", "A (RI) / B (RE)", "f", 1, "t", 2, "AC", "A (RI) / C (RE)", "g", 1, "t"),
        ("u", 2, 1, "AC", "A", "f", 1, "t", 2, "AC", "Z", "g", 1, "t")], ddl)
    members = recovery.pair_members(pairs)
    assert {r["cluster"]: r["fornecedor"] for r in recovery.rebuild_groups(members).collect()} == {"s": "A", "u": "A"}
    audited = spark.createDataFrame([(1, "s", 1, 1, "exact"), (2, "s", 2, 7, "loose")],
                                    "occ_id long, sha256 string, inep long, pagina int, pdf_url string")
    urls = {(r["sha256"], r["inep"]): r["pdf_url"] for r in recovery.fill_urls(members, audited).collect()}
    assert urls == {("s", 1): "exact", ("s", 2): "loose", ("u", 1): None, ("u", 2): None}
