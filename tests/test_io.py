"""Sources, sinks, streams and the Arrow jobs."""

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise import session
from reprise.operators import occurrences, rasters, register
from reprise.schemas import schema
from reprise.sources import readers, sinks
from reprise.streaming import jobs


def test_cache_reader_splits_markers_and_skips_bad_lines(spark, tmp_path):
    lines = [
        {"inep": 1, "pdf_url": "u", "pagina": 1, "sha256": "a", "phash": "ffffffffffffffff"}, {"_pdf_ok": "u"},
        {"_escola_concluida": 1}]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    rows, done = readers.read_cache(spark, str(tmp_path))
    assert [(r["sha256"], r["phash"]) for r in rows.collect()] == [("a", -1)]
    assert [r["pdf_url"] for r in done.collect()] == ["u"]


def test_memo_last_line_wins_and_empty_reading_is_kept(spark, tmp_path):
    for name, lines in (("memo", ['{"s":"a","p":"01","w":1,"h":1,"t":"x"}', '{"s":"a","p":"02","w":2,"h":1,"t":"y"}']),
                        ("geo", ['{"s":"a","lat":-1.5,"lon":-40.0}', '{"s":"b","lat":null,"lon":null}'])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.jsonl").write_text("\n".join(lines))
    assert readers.read_hash_memo(spark, str(tmp_path / "memo")).first()["phash"] == 2
    got = {r["sha256"]: r["lat"] for r in readers.read_coordinates(spark, str(tmp_path / "geo")).collect()}
    assert got == {"a": -1.5, "b": None}
    (tmp_path / "classes.json").write_text('{"a": "foto", "b": "logo"}')
    classes = readers.read_json_map(spark, str(tmp_path / "classes.json"), "string", "sha256", "classe")
    assert {tuple(r) for r in classes.collect()} == {("a", "foto"), ("b", "logo")}


def test_register_csv(spark, tmp_path):
    head = "INEP,UF,fornecedor_ri,fornecedor_re,FASE,Status Geral,Books,Atualizacao,Ativação Rede externa,Ativação Rede interna"
    (tmp_path / "r.csv").write_text(head + '\n12,ac,A,B,5.0,,"//h/a.pdf, https://h/b.pdf",2026-01-02,,\n', encoding="utf-8")
    row = register.typed_export(readers.read_register_csv(spark, str(tmp_path / "r.csv"))).first()
    assert (row["inep"], row["uf"], row["fase"], row["fornecedor"]) == (12, "AC", "5", "A (RI) / B (RE)")
    assert row["books"] == ["https://h/a.pdf", "https://h/b.pdf"] and row["status_geral"] == "Conectada"


def test_pdf_folder_to_occurrences(spark, tmp_path):
    """A toy container: width, height and page per image, then one byte of content."""
    pack = lambda *imgs: b"".join(struct.pack("<HHHB", *i) for i in imgs)
    (tmp_path / "a.pdf").write_bytes(pack((640, 480, 1, 7), (640, 480, 3, 7), (50, 50, 2, 9)))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")

    def extractor(path, content):
        if len(content) % 7:
            raise ValueError(path)
        return [{"xref": c, "pagina": p, "width": w, "height": h, "uniforme": False, "conteudo": bytes([c])}
                for w, h, p, c in struct.iter_unpack("<HHHB", content)]

    pdfs = readers.read_pdfs(spark, str(tmp_path))
    exploded = occurrences.extract(pdfs, extractor)
    folded = occurrences.fold_pages(occurrences.valid_images(occurrences.with_digest(exploded))).collect()
    assert [(r["paginas"], r["ocorrencias_no_pdf"]) for r in folded] == [([1, 3], 2)]
    status = {os.path.basename(r["pdf_url"]): r["status"] for r in occurrences.pdf_status(pdfs, exploded).collect()}
    assert status == {"a.pdf": "ok", "b.pdf": "vazio_ou_falha"}
    assert readers.list_files(spark, str(tmp_path), "*.txt").first()["name"] == "c.txt"


def test_run_partition_is_replaced_alone_and_deleted(spark, tmp_path):
    root = str(tmp_path / "runs")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "grupo_id string")
    sinks.write_run({"grupos": frame("G1", "G2")}, root, "r1")
    sinks.write_run({"grupos": frame("G9")}, root, "r2")
    sinks.write_run({"grupos": frame("G3")}, root, "r1")
    assert {r["grupo_id"] for r in readers.read_run(spark, f"{root}/grupos", "r1").collect()} == {"G3"}
    sinks.delete_run(spark, root, "r1", ("grupos",))
    assert {r["grupo_id"] for r in spark.read.parquet(f"{root}/grupos").collect()} == {"G9"}


def test_upsert_backup_append_and_csv(spark, tmp_path):
    path = str(tmp_path / "marks")
    rows = lambda *v: spark.createDataFrame(list(v), "k string, n int, v string")
    sinks.write_upsert(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), path, ["k"], ["n"])
    sinks.write_upsert(rows(("b", 5, "w")), path, ["k"], ["n"])
    sinks.write_upsert(rows(("b", 5, "w")), path, ["k"], ["n"])
    assert sorted(map(tuple, sinks.read_latest(spark, path).collect())) == [("a", 2, "y"), ("b", 5, "w")]
    (tmp_path / "marks" / "v9").mkdir()
    assert sinks.finished_versions(spark, path) == [0, 1, 2]
    sinks.backup(sinks.read_latest(spark, path), str(tmp_path / "bkp"))
    try:
        sinks.backup(sinks.read_latest(spark, path), str(tmp_path / "bkp"))
        raise AssertionError("an existing backup was replaced")
    except Exception as e:  # noqa: BLE001
        assert "exist" in str(e).lower()
    sinks.append(rows(("c", 1, "q")), str(tmp_path / "bkp"))
    assert spark.read.parquet(str(tmp_path / "bkp")).count() == 3
    sinks.write_case_csv(rows(("a;b", 1, "é")), str(tmp_path / "csv"))
    parts = [f.read_bytes() for f in (tmp_path / "csv").glob("*.csv")]
    assert all(p.startswith(b"\xef\xbb\xbf") for p in parts) and any(b'"a;b";1;' in p for p in parts)
    sinks.write_report({"Resumo Geral": rows(("a", 1, "x"))}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "resumo_geral")).count() == 1


def test_streams_resume_without_repeats(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ddl = "pdf_url string, sha256 string"
    write = lambda *v: spark.createDataFrame(list(v), ddl).write.mode("append").parquet(src)
    frame = spark.createDataFrame([], ddl)
    write(("u1", "a"), ("u2", "a"), ("u1", "b"))
    jobs.append_unseen(jobs.stream_table(spark, src, "*.parquet", frame.schema, 1), ["sha256"], out, ck, "pdf_url")
    write(("u3", "a"), ("u0", "c"))
    jobs.append_unseen(jobs.stream_table(spark, src, "*.parquet", frame.schema, 1), ["sha256"], out, ck, "pdf_url")
    assert sorted(r["sha256"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_replay_is_idempotent(spark, tmp_path):
    src, target, ck = (str(tmp_path / n) for n in ("q", "t", "ck"))
    ddl = "k string, n int"
    for v in (("a", 1), ("b", 2)), (("a", 3),), (("a", 3),):
        spark.createDataFrame(list(v), ddl).write.mode("append").parquet(src)
        jobs.replay_queue(jobs.stream_table(spark, src, "*.parquet", schema_of(spark, ddl)), target, ["k"], "n", ck)
    assert sorted(map(tuple, sinks.read_latest(spark, target).collect())) == [("a", 3), ("b", 2)]


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_watermarked_dedup_is_bounded(spark, tmp_path):
    ddl = "sha256 string, ts timestamp"
    spark.createDataFrame([("a", None)], ddl).select("sha256", F.lit("2026-01-01").cast("timestamp").alias("ts")).write.parquet(
        str(tmp_path / "in"))
    rows = jobs.stream_table(spark, str(tmp_path / "in"), "*.parquet", schema_of(spark, ddl))
    assert jobs.run_to_table(jobs.first_seen(rows, ["sha256"], "ts"), "dedup").count() == 1


def test_perceptual_hash_matches_direct_transform(spark):
    rng = np.random.default_rng(3)
    pictures = rng.integers(0, 256, (3, 32, 32))
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(pictures)], "i int, raster array<int>")
    got = {r["i"]: r["h"] & (2**64 - 1) for r in df.select("i", rasters.perceptual_hash(F.col("raster")).alias("h")).collect()}
    for i, picture in enumerate(pictures):
        low = [[sum(picture[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64)
                    for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        flat = [c for row in low for c in row]
        middle = (sorted(flat)[31] + sorted(flat)[32]) / 2
        assert got[i] == int("".join("1" if c > middle else "0" for c in flat), 2)


def test_measures_of_flat_and_noisy_rasters(spark):
    noise = np.random.default_rng(1).integers(0, 256, (16, 16))
    rows = [(1, 16, [250] * 256, [250, 250, 250] * 4), (2, 16, noise.ravel().tolist(), [0, 128, 255] * 4), (3, 4, [0] * 16, [0, 0, 0])]
    df = spark.createDataFrame(rows, "i int, largura int, cinza array<int>, rgb array<int>")
    got = {r["i"]: r for r in rasters.with_measures(df).collect()}
    assert (got[1]["uniformidade"], got[1]["chapado"], got[1]["branco"], got[1]["cores"]) == (1.0, 1.0, 1.0, 1)
    assert got[2]["uniformidade"] == 0.0 and got[2]["saturacao"] == 255.0
    assert got[3]["uniformidade"] is None


def test_schemas_parse():
    for name in ("register", "occurrence", "run", "mark", "lot", "document", "trail", "pending", "pair", "run_group"):
        assert schema(name).fields


class FakeSession:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})


def test_shared_folder_rule():
    assert session.shared_dir(FakeSession("yarn", "hdfs://shared")) == "hdfs://shared"
    local = session.shared_dir(FakeSession("local[2]"))
    assert os.path.isdir(local) and session.shared_dir(FakeSession("local[2]")) == local
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn"))
