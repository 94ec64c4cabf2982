"""Retry queue: kinds, failures, attempts, repeated batches."""

import json

import pytest
from pyspark.sql import functions as F

from reprise.schemas import schema
from reprise.sources import readers
from reprise.streaming import jobs, retry

DOC = "doc_id string, envio_id string, tamanho_bytes bigint"
LINE = "envio_id string, par_id string, qtd_imagens bigint"
EVENT = "tipo string, envio_id string, detalhe string"


@pytest.fixture()
def table(spark):
    of = lambda ddl: spark.createDataFrame([], ddl).schema
    return retry.routes({"envio": schema("lot"), "pares": of(LINE), "documento": of(DOC), "evento": of(EVENT)}, {"documento": F.col("tamanho_bytes") > 100})


def item(i, kind, body, at=None, tries=0):
    return (i, kind, body if body is None or isinstance(body, str) else json.dumps(body), float(at if at is not None else i), tries)


ITEMS = [
    item(1, "envio", [{"envio_id": "e1", "status": "enviado"}]),
    item(2, "pares", [{"envio_id": "e1", "par_id": "1x2", "qtd_imagens": 3}, {"envio_id": "e1", "par_id": "3x4", "qtd_imagens": 1}]),
    item(3, "documento", {"doc_id": "d1", "envio_id": "e1", "tamanho_bytes": 7}),
    item(4, "evento", [{"tipo": "envio_criado", "envio_id": "e1", "detalhe": "{}"}]),
    item(5, "envio_completo", {"cabecalho": {"envio_id": "e2", "status": "enviado"}, "linhas": [{"envio_id": "e2", "par_id": "5x6", "qtd_imagens": 2}]}),
    item(6, "envio_completo", {"cabecalho": {"envio_id": "e3"}, "linhas": [{"envio_id": "e3", "par_id": ""}]}),  # one bad line: nothing of it
    item(7, "envio_completo", {"linhas": [{"envio_id": "e9", "par_id": "9x9"}]}),
    item(8, "documento", {"doc_id": "d2", "tamanho_bytes": 900}),
    item(9, "laudo", {"doc_id": "d3"}),
    item(10, "evento", '{"tipo": "quebr'),
    item(11, "pares", None),
    item(12, "envio", [{"status": "x"}]),
    item(13, "envio", [{"envio_id": "e1", "status": "recebido"}], at=0.5),  # older than item 1
    item(14, "evento", [{"tipo": "a"}, {"tipo": "b"}]),
    item(15, "envio", []),
]
KEPT = {6: retry.NO_KEY, 7: retry.NO_KEY, 8: retry.REFUSED, 9: retry.UNKNOWN, 10: retry.UNREADABLE, 11: retry.UNREADABLE, 12: retry.NO_KEY, 15: retry.NO_KEY}


def run(spark, tmp_path, table, files, name, first=0, root=None):
    folder, root = str(tmp_path / f"queue-{name}"), root or str(tmp_path / "tables")
    for rows in files:
        spark.createDataFrame(rows, retry.QUEUE).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.stream_table(spark, folder, "*.parquet", spark.createDataFrame([], retry.QUEUE).schema, 1)
    retry.replay(stream, table, root, str(tmp_path / f"offsets-{name}"), first)
    return root


def state(spark, root, table):
    return {k: sorted((tuple(r) for r in retry.stored(spark, root, k, table[k]).select(*cols).collect()), key=repr)
            for k, cols in (("envio", ["envio_id", "status"]), ("pares", ["envio_id", "par_id", "qtd_imagens"]), ("documento", ["doc_id"]), ("evento", ["tipo"]))}


WANT = {"envio": [("e1", "enviado"), ("e2", "enviado")], "pares": [("e1", "1x2", 3), ("e1", "3x4", 1), ("e2", "5x6", 2)], "documento": [("d1",)],
        "evento": [("a",), ("b",), ("envio_criado",)]}


def test_items_are_routed_and_failures_stay(spark, tmp_path, table):
    root = run(spark, tmp_path, table, [ITEMS[:5], ITEMS[5:10], ITEMS[10:]], "a")
    assert state(spark, root, table) == WANT
    left = {r.item_id: (r.motivo, r.tentativas) for r in retry.kept(spark, root).collect()}
    assert left == {i: (m, 1) for i, m in KEPT.items()}
    # Batches that run again, as after a lost driver, change nothing.
    for n, part in enumerate((ITEMS[:5], ITEMS[5:10], ITEMS[10:])):
        retry.replay_batch(spark.createDataFrame(part, retry.QUEUE), table, root, n)
    assert state(spark, root, table) == WANT and retry.kept(spark, root).count() == len(KEPT)


def test_kept_items_go_through_once_their_kind_is_known(spark, tmp_path, table):
    root = run(spark, tmp_path, table, [ITEMS], "first")
    again, first = str(tmp_path / "queue-again"), retry.next_batch(spark, root)
    retry.requeue(spark, root, again)
    more = table | retry.routes({"laudo": spark.createDataFrame([], "doc_id string").schema})
    stream = jobs.stream_table(spark, again, "*.parquet", spark.createDataFrame([], retry.QUEUE).schema, 1)
    retry.replay(stream, more, root, str(tmp_path / "offsets-again"), first)
    left = {r.item_id: (r.motivo, r.tentativas) for r in retry.kept(spark, root, first).collect()}
    assert left == {i: (m, 2) for i, m in KEPT.items() if i != 9}
    assert [r.doc_id for r in retry.stored(spark, root, "laudo", more["laudo"]).collect()] == ["d3"]
    assert state(spark, root, table) == WANT


def test_empty_queue(spark, tmp_path, table):
    root = str(tmp_path / "tables")
    retry.replay_batch(spark.createDataFrame([], retry.QUEUE), table, root, 0)
    assert retry.kept(spark, root).collect() == [] and all(v == [] for v in state(spark, root, table).values())


def test_alerts_of_crowded_images(spark):
    known = spark.createDataFrame([(s, "img", "A (RI) / B (RE)" if s % 2 else "C") for s in range(1, 41)] + [(7, "rare", "A (RI) / B (RE)"), (None, "rare", "A")],
                                  "inep long, sha256 string, fornecedor string")
    history, crowded = jobs.known_images(known, block=6)
    assert [(r.sha256, r.slices) for r in crowded.collect()] == [("img", 7)]
    incoming = spark.createDataFrame([(1, 5, "img", "B"), (2, 6, "img", "Z"), (3, 9, "rare", "A"), (4, 7, "rare", "A"), (5, None, "img", "A"), (6, 1, "none", "A")],
                                     "occ_id long, inep long, sha256 string, fornecedor string")
    got = sorted((r.occ_id, r.outro_inep) for r in jobs.alerts(incoming, history, crowded).collect())
    assert got == sorted([(1, s) for s in range(1, 41, 2) if s != 5] + [(3, 7)])


def test_a_memo_batch_opens_only_its_buckets(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "sha256 string").coalesce(1)
    rows(*[f"d{i}" for i in range(300)]).write.parquet(src)
    stream = lambda: jobs.stream_table(spark, src, "*.parquet", rows("x").schema, 1)
    jobs.append_unseen(stream(), ["sha256"], out, ck)
    seen = []
    real = jobs.memo_rows

    def watched(*args):
        df = real(*args)
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        seen.append((args[3], plan.toString(), df.select(F.input_file_name().alias("f")).distinct().collect()))
        return df
    jobs.memo_rows = watched
    try:
        rows("d5", "brand new").write.mode("append").parquet(src)
        jobs.append_unseen(stream(), ["sha256"], out, ck)
    finally:
        jobs.memo_rows = real
    touched, plan, opened = seen[0]
    assert 1 <= len(touched) <= 2 and "PartitionFilters: [isnotnull" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull")
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in opened} <= set(touched)
    assert spark.read.parquet(out).count() == 301
    assert readers.read_table(spark, out).select("sha256").distinct().count() == 301
