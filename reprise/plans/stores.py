"""Runnable queries of sources, sinks and streams. What a source reads was written from the input tables by the sink beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.operators import ledger, marks, pairs, register
from reprise.plans import catalog
from reprise.plans.catalog import query
from reprise.plans.views import FIRST_SCHOOL, Views
from reprise.schemas import PDF_MARKER, SCHOOL_MARKER, schema
from reprise.session import materialise, scratch_path
from reprise.sources import readers, sinks
from reprise.streaming import jobs, retry

BATCHES = 3


def _arriving(v: Views, rows: DataFrame, label: str) -> DataFrame:
    """A stream over ``rows`` that arrives in three batches of files, at least one for each core: a file is read by few tasks."""
    each = max(1, v.spark.sparkContext.defaultParallelism, int(v.spark.conf.get("spark.sql.shuffle.partitions")) // (4 * BATCHES))
    folder = scratch_path(v.spark, f"{label}-arriving")
    rows.repartition(each * BATCHES).write.parquet(folder)
    return jobs.stream_table(v.spark, folder, "*.parquet", rows.schema, each)


def _documents(v: Views) -> DataFrame:
    d = F.col("doc_id")
    return v.table("documents").select(
        d.alias("occ_id"), (FIRST_SCHOOL + d % 23).alias("inep"),
        F.concat(F.lit("https://cdn.example.org/"), d % 69, F.lit(".pdf")).alias("pdf_url"),
        F.concat(F.lit("RI"), d % 2, F.lit(" (RI) / RE"), d % 5, F.lit(" (RE)")).alias("fornecedor"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# ----------------------------------------------------------------------------------------------------------- streams

@query
def stream_append(v: Views) -> DataFrame:
    return jobs.run_to_table(_arriving(v, _documents(v), "append"), "stream-append")


@query
def stream_dedup(v: Views) -> DataFrame:
    target = scratch_path(v.spark, "stream-dedup")
    jobs.append_unseen(_arriving(v, _documents(v), "dedup"), ["pdf_url", "sha256"], target, scratch_path(v.spark, "stream-dedup-offsets"))
    return v.spark.read.parquet(target).select("pdf_url", "sha256")


@query
def stream_new_digests(v: Views) -> DataFrame:
    target = scratch_path(v.spark, "stream-memo")
    jobs.keep_smallest(
        _arriving(v, _documents(v), "memo"), ["sha256"], ["pdf_url"], target, scratch_path(v.spark, "stream-memo-offsets"))
    return sinks.read_latest(v.spark, target).select("sha256", "pdf_url")


@query
def stream_alerts(v: Views) -> DataFrame:
    target, columns = scratch_path(v.spark, "stream-alerts"), ["occ_id", "inep", "sha256", "outro_inep"]
    jobs.known_image_alerts(_arriving(v, _documents(v), "alerts"), v.occ, target, scratch_path(v.spark, "stream-alerts-offsets"), columns)
    return v.spark.read.parquet(target).select(*columns)


@query
def stream_marks(v: Views) -> DataFrame:
    """Same state as ``marks_state``, through the trail."""
    trail = scratch_path(v.spark, "trail")
    jobs.mark_events_to_trail(_arriving(v, v.mark_events, "marks"), trail, scratch_path(v.spark, "trail-offsets"))
    return marks.current_marks(v.spark.read.parquet(trail))


@query
def stream_replay(v: Views) -> DataFrame:
    """Retry queue of order writes, merged by (customer, priority); late writes do not undo newer ones."""
    orders = v.table("orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    target = scratch_path(v.spark, "replay")
    jobs.replay_queue(
        _arriving(v, orders, "replay"), target, ["o_custkey", "o_orderpriority"], "o_orderkey",
        scratch_path(v.spark, "replay-offsets"), newest=True)
    return sinks.read_latest(v.spark, target)


# -------------------------------------------------------------------------------------------------------- retry queue

LINE = "envio_id string, par_id string, qtd_imagens bigint"
DOCUMENT = "doc_id string, envio_id string, tamanho_bytes bigint"
EVENT = "tipo string, envio_id string, detalhe string"


def _queue(v: Views) -> DataFrame:
    """Every order is a write that once failed: lots, lines, documents, events, whole lots, and one kind nobody knows at first.
    Some are cut off, some lack their key, some documents are too large."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("envio", "pares", "documento", "evento", "envio_completo", "laudo", "envio"))), (k % 7 + 1).cast("int"))
    lot = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("aud_"), F.floor(k / 50)))
    header = F.struct(lot.alias("envio_id"), F.concat(F.lit("run_"), k % 5).alias("run_id"), F.when(k % 7 == 6, "recebido").otherwise("enviado").alias("status"))
    line = lambda n: F.struct(lot.alias("envio_id"), F.concat(F.floor(k / 20), F.lit("x"), n).alias("par_id"), (k % 9 + n).alias("qtd_imagens"))
    lines = F.array(line(F.lit(1)), line(F.lit(2)))
    document = F.struct(F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("doc_"), F.floor(k / 30))).alias("doc_id"),
                        F.concat(F.lit("aud_"), F.floor(k / 50)).alias("envio_id"), (k % 400 * 100000).alias("tamanho_bytes"))
    event = F.struct(F.lit("documento_anexado").alias("tipo"), F.concat(F.lit("aud_"), F.floor(k / 50)).alias("envio_id"),
                     F.to_json(F.struct((k % 3).alias("n"))).alias("detalhe"))
    body = (
        F.when(kind == "envio", F.to_json(F.array(header))).when(kind == "pares", F.to_json(lines))
        .when(kind == "evento", F.to_json(F.array(event)))
        .when(kind == "envio_completo", F.to_json(F.struct(header.alias("cabecalho"), lines.alias("linhas")))).otherwise(F.to_json(document))
    )
    body = F.when(k % 13 == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    return v.table("orders").select(
        k.cast("long").alias("item_id"), kind.alias("tipo"), body.alias("carga"), k.cast("double").alias("criado_em"), F.lit(0).alias("tentativas"))


def _replayed(v: Views) -> tuple[str, dict[str, retry.Route], int]:
    """(tables, routes, first batch of the second run) after the queue ran in three batches, and what it kept once more with
    the last kind known."""
    of = T.StructType.fromDDL
    routes = retry.routes({"envio": schema("lot"), "pares": of(LINE), "documento": of(DOCUMENT), "evento": of(EVENT)},
                          {"documento": F.col("tamanho_bytes") > ledger.MAX_DOCUMENT_BYTES})
    root, again = scratch_path(v.spark, "retry"), scratch_path(v.spark, "retry-again")
    retry.replay(_arriving(v, _queue(v), "retry"), routes, root, scratch_path(v.spark, "retry-offsets"))
    routes = routes | retry.routes({"laudo": of(DOCUMENT)})
    second = retry.next_batch(v.spark, root)
    retry.requeue(v.spark, root, again)
    stream = jobs.stream_table(v.spark, again, "*.parquet", of(retry.QUEUE))
    retry.replay(stream, routes, root, scratch_path(v.spark, "retry-again-offsets"), second)
    return root, routes, second


@query
def replay_failures(v: Views) -> DataFrame:
    """Items that stay queued, with their reason and attempts."""
    root, _, second = _replayed(v)
    return retry.kept(v.spark, root, second).select("item_id", "tipo", "motivo", "tentativas")


@query
def replay_stored(v: Views) -> DataFrame:
    """Rows of every kind after the replay, as (kind, key, value)."""
    root, routes, _ = _replayed(v)
    rows = {k: retry.stored(v.spark, root, k, r) for k, r in routes.items()}
    out = rows["envio"].select(F.lit("envio").alias("tipo"), F.col("envio_id").alias("chave"), F.concat_ws("/", "run_id", "status").alias("valor"))
    for kind, key, value in (
            ("pares", F.concat_ws("/", "envio_id", "par_id"), F.col("qtd_imagens").cast("string")),
            ("documento", F.col("doc_id"), F.col("tamanho_bytes").cast("string")), ("evento", F.col("envio_id"), F.col("detalhe")),
            ("laudo", F.col("doc_id"), F.col("tamanho_bytes").cast("string"))):
        out = out.unionByName(rows[kind].select(F.lit(kind).alias("tipo"), key.alias("chave"), value.alias("valor")))
    return out


# -------------------------------------------------------------------------------------------- ledger headers and events

@query
def lot_headers(v: Views) -> DataFrame:
    """Header row of every lot, its summary taken apart."""
    rows = ledger.lot_headers(materialise(ledger.lot_lines(v.lot_requests, catalog._cases(v)), "lot-lines"), "fase5_todos", "5", F.lit("2026-01-01 00:00:00"))
    field = lambda name: F.get_json_object("resumo", f"$.{name}").cast("long").alias(name)
    return rows.select("envio_id", "run_id", "fase", "criado_em", "autor", "status", *map(field, ("pares", "escolas", "imagens", "fotos_camera")),
                       F.get_json_object("resumo", "$.ufs").alias("ufs"))


@query
def lot_events(v: Views) -> DataFrame:
    """Trail rows of all lots made, documents attached and marks changed."""
    lines = ledger.lot_lines(v.lot_requests, catalog._cases(v))
    made = ledger.lot_created_events(lines, F.lit("2026-01-01 00:00:00"))
    attached = ledger.document_events(ledger.document_rows(v.uploads))
    changed = ledger.mark_events(marks.accepted(v.mark_events))
    rows = made.unionByName(attached).unionByName(changed)
    field = lambda name: F.get_json_object("detalhe", f"$.{name}").alias(name)
    return rows.select("tipo", "envio_id", "par_id", "doc_id", "inep", "criado_em", *map(field, ("pares", "arquivo_nome", "falso_positivo", "motivo_codigo")))


@query
def audited_nested(v: Views) -> DataFrame:
    """Audited rows with their counterparts in one list per row, as one table."""
    m = catalog._members(v)
    nested = pairs.nest_counterparts(pairs.audited_rows(v.occ, m), pairs.counterparts(m))
    other = F.transform(F.coalesce("duplicada_com", F.array()), lambda x: F.concat_ws(":", x["outro_inep"].cast("string"), x["outro_pagina"].cast("string"), x["outro_pdf_url"]))
    return nested.select("occ_id", "inep", "sha256", "tem_duplicata", F.array_join("grupos", " ").alias("grupos"), F.array_join(other, "|").alias("duplicada_com"))


@query
def audited_first_page(v: Views) -> DataFrame:
    """First page of the audited list: duplicates first, then by school, an unknown school as 0."""
    listed = pairs.filter_audited(pairs.audited_rows(v.occ, catalog._members(v)))
    order = [F.desc("tem_duplicata"), F.coalesce("inep", F.lit(0)), "occ_id"]
    return pairs.page_slice(listed, order, page=1, limit=200).select("occ_id", "inep", "tem_duplicata")


@query
def register_rejected(v: Views) -> DataFrame:
    """Export rows without a usable school id; every fifth loses it on the way in."""
    raw = v.export_raw.withColumn("INEP", F.when(F.col("INEP").cast("long") % 5 == 0, F.when(F.col("INEP").cast("long") % 2 == 0, "")).otherwise(F.col("INEP")))
    rows = register.rejected_rows(register.typed_export(raw))
    return rows.groupBy("uf", "fase").agg(F.count(F.lit(1)).alias("linhas"))


# ------------------------------------------------------------------------------------------------- sources and sinks

@query
def cache_scan(v: Views) -> DataFrame:
    """Line-JSON cache of occurrences with both kinds of markers and broken lines between, read back."""
    occ = v.occ.withColumn("phash", F.substring("sha256", 1, 16))
    lines = occ.select(F.to_json(F.struct("inep", "pdf_url", "pagina", "sha256", "phash")).alias("value"))
    done = occ.select("pdf_url").distinct().select(F.to_json(F.struct(F.col("pdf_url").alias(PDF_MARKER))).alias("value"))
    schools = occ.where("inep is not null").select("inep").distinct().select(F.to_json(F.struct(F.col("inep").alias(SCHOOL_MARKER))).alias("value"))
    broken = occ.where("occ_id % 10 = 3").select(F.substring("sha256", 1, 9).alias("value"))
    path = scratch_path(v.spark, "cache")
    lines.unionByName(done).unionByName(schools).unionByName(broken).repartition(4).write.text(path)
    rows, finished = readers.read_cache(v.spark, path)
    read = rows.groupBy("pdf_url").agg(F.count(F.lit(1)).alias("imagens"), F.sum(F.shiftrightunsigned("phash", 48)).alias("soma"))
    return read.join(finished, "pdf_url")


@query
def register_csv_scan(v: Views) -> DataFrame:
    """The register export through a CSV file with quotes and accents."""
    path = scratch_path(v.spark, "register-csv")
    v.export_raw.write.option("header", True).option("escape", '"').csv(path)
    return register.typed_export(readers.read_register_csv(v.spark, path)).select(
        "inep", "uf", "fornecedor", "fase", "status_geral", F.size("books").cast("long").alias("qtd_books"))


@query
def memo_scan(v: Views) -> DataFrame:
    """Hash memo of line JSON; the last line of a digest counts."""
    path = scratch_path(v.spark, "memo")
    h = v.content_hashes
    line = lambda p, w: F.to_json(F.struct(F.col("sha256").alias("s"), F.lower(F.lpad(F.hex(p), 16, "0")).alias("p"), w.alias("w"), F.lit(3).alias("h"), F.lit("t.jpg").alias("t")))
    both = h.select("sha256", F.posexplode(F.array(line(F.col("base_id"), F.lit(1)), line(F.col("phash"), F.lit(2)))).alias("vez", "value"))
    # One file, in which the second line of every digest comes later.
    both.orderBy("vez").select("value").coalesce(1).write.text(path)
    return readers.read_hash_memo(v.spark, path).select("sha256", F.lower(F.lpad(F.hex("phash"), 16, "0")).alias("phash"), "width")


@query
def coordinate_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "coordinates")
    v.coordinates.select(F.to_json(F.struct(F.col("sha256").alias("s"), "lat", "lon"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return readers.read_coordinates(v.spark, path).select("sha256", "lat", "lon")


@query
def class_map_scan(v: Views) -> DataFrame:
    """Classes as one JSON object, its entries over many lines and tasks."""
    path = scratch_path(v.spark, "classes")
    sinks.write_json_map(v.classes.select("sha256", "classe"), "sha256", "classe", path)
    return readers.read_json_map(v.spark, path, "string", "sha256", "classe")


@query
def run_tables(v: Views) -> DataFrame:
    """Two runs written, one of them twice, one deleted; what is left of both tables."""
    root = scratch_path(v.spark, "runs")
    m = catalog._members(v).select("grupo_id", "inep", "sha256")
    rows = pairs.audited_rows(v.occ, catalog._members(v)).select("occ_id", "inep", "tem_duplicata")
    for run in ("r1", "r2", "r1", "r3"):
        sinks.write_run({"membros": m, "analisados": rows}, root, run)
    sinks.delete_run(v.spark, root, "r2", ("membros", "analisados"))
    left = None
    for run in ("r1", "r2", "r3"):
        members = readers.read_run(v.spark, f"{root}/membros", run).agg(F.count(F.lit(1)).alias("membros"), F.count_distinct("sha256").alias("imagens"))
        audited = readers.read_run(v.spark, f"{root}/analisados", run).agg(F.count(F.lit(1)).alias("linhas"), F.count_if("tem_duplicata").alias("duplicadas"))
        one = members.withColumn("run_id", F.lit(run)).join(audited.withColumn("run_id", F.lit(run)), "run_id")
        left = one if left is None else left.unionByName(one)
    return left


@query
def table_copies(v: Views) -> DataFrame:
    """Append sink, backup and full scan: the register in two halves, appended, copied, read back."""
    path, copy = scratch_path(v.spark, "appended"), scratch_path(v.spark, "backup")
    rows = v.register.select("escola_id_bubble", "inep", "uf", "fornecedor", "fase")
    sinks.append(rows.where("inep % 2 = 0"), path)
    sinks.append(rows.where("inep % 2 = 1"), path)
    sinks.backup(readers.read_table(v.spark, path), copy)
    return readers.read_table(v.spark, copy).select("escola_id_bubble", "inep", "uf", "fornecedor", "fase")


@query
def file_scan(v: Views) -> DataFrame:
    """Files of a folder as binary rows: one file for each of eight slices of the documents."""
    path = scratch_path(v.spark, "files")
    digests = v.occ.select("sha256", (F.col("occ_id") % 8).alias("fatia"))
    digests.repartition("fatia").write.partitionBy("fatia").text(path)
    files = readers.read_pdfs(v.spark, path, "*.txt")
    slice_ = F.regexp_extract("path", r"fatia=(\d+)", 1).cast("long").alias("fatia")
    return files.groupBy(slice_).agg(F.sum("length").alias("bytes"))


@query
def digest_lookup(v: Views) -> DataFrame:
    """Order lines whose part is on a list of digests."""
    wanted = v.table("part").where("p_size % 10 = 3").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    return readers.rows_with_digests(v.line_occ.select("occ_id", "sha256", "inep"), wanted).groupBy("sha256").agg(F.count(F.lit(1)).alias("linhas"))
