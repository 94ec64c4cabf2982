"""Audit lots: immutable copies of forwarded cases, their documents and the trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.functions import text

# Fixed values ---------------------------------------------------------------------------------------------------------
MAX_DOCUMENT_BYTES = 25 * 1024 * 1024
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "png", "jpg", "jpeg", "zip")
# ----------------------------------------------------------------------------------------------------------------------


def first_selection(requests: DataFrame) -> DataFrame:
    """Requested pairs per lot without blanks and repeats; the first position wins."""
    return requests.where("par_id <> ''").groupBy("envio_id", "par_id").agg(F.min("posicao").alias("posicao"))


def lot_lines(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Selected pairs that exist in the run, with queryable columns and the whole case as a JSON snapshot."""
    chosen = first_selection(requests).join(pairs, "par_id")
    snapshot = F.to_json(F.struct(*[F.col(c) for c in pairs.columns]))
    return chosen.select(
        "envio_id", "par_id", "posicao", "inep_a", "inep_b", "uf_a", "uf_b", "municipio_a", "municipio_b", "escola_a",
        "escola_b", "fornecedores", "qtd_imagens", F.col("qtd_fotos_camera").alias("qtd_fotos"), "mesmo_pdf",
        "pdf_divergente", "fora_do_raio", "distancia_max_m", snapshot.alias("snapshot"),
    )


def lot_summary(lines: DataFrame) -> DataFrame:
    """Counters and bounded lists (supplier names, states) per lot. A lot without an existing pair has no row."""
    facts = lines.groupBy("envio_id").agg(
        F.count(F.lit(1)).alias("pares"), F.sum("qtd_imagens").alias("imagens"), F.sum("qtd_fotos").alias("fotos_camera"),
        F.count_if("mesmo_pdf").alias("mesmo_pdf"), F.count_if("pdf_divergente").alias("pdf_divergente"))
    schools = lines.select("envio_id", F.explode(F.array("inep_a", "inep_b")).alias("inep")).distinct().groupBy(
        "envio_id").agg(F.count(F.lit(1)).alias("escolas"))
    names = lines.select("envio_id", F.explode("fornecedores").alias("n")).distinct().groupBy("envio_id").agg(
        F.sort_array(F.collect_list("n")).alias("fornecedores"))
    states = lines.select("envio_id", F.explode(F.array("uf_a", "uf_b")).alias("u")).where("u <> ''").distinct().groupBy(
        "envio_id").agg(F.sort_array(F.collect_list("u")).alias("ufs"))
    return facts.join(schools, "envio_id").join(names, "envio_id", "left").join(states, "envio_id", "left")


def lot_headers(lines: DataFrame, run_id: str, phase: str, created: Column, author: Column | None = None,
                remark: Column | None = None) -> DataFrame:
    """Header row of each lot: its run, phase, author, status and the summary as JSON."""
    summary = lot_summary(lines)
    counts = [c for c in summary.columns if c != "envio_id"]
    return summary.select(
        "envio_id", F.lit(run_id).alias("run_id"), F.lit(phase).alias("fase"), created.alias("criado_em"),
        F.coalesce(F.lit("") if author is None else author, F.lit("")).alias("autor"),
        F.coalesce(F.lit("") if remark is None else remark, F.lit("")).alias("observacao"), F.lit("enviado").alias("status"),
        F.to_json(F.struct(*counts)).alias("resumo"))


def _events(rows: DataFrame, kind: str, created: Column, detail: list[Column], **ids: Column) -> DataFrame:
    """Trail rows of one kind; ids that are not given are null."""
    kinds = {"envio_id": "string", "par_id": "string", "doc_id": "string", "inep": "long"}
    return rows.select(
        F.lit(kind).alias("tipo"), *[ids.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()],
        F.to_json(F.struct(*detail), {"ignoreNullFields": "false"}).alias("detalhe"), created.cast("string").alias("criado_em"))


def lot_created_events(lines: DataFrame, created: Column) -> DataFrame:
    """One event per lot, with the number of its pairs and its schools; a lot's schools are as many as its pairs at most."""
    schools = lot_schools(lines).groupBy("envio_id").agg(F.sort_array(F.collect_list("inep")).alias("ineps"))
    lots = lines.groupBy("envio_id").agg(F.count(F.lit(1)).alias("pares")).join(schools, "envio_id")
    return _events(lots, "envio_criado", created, [F.col("pares"), F.col("ineps")], envio_id=F.col("envio_id"))


def document_events(documents: DataFrame) -> DataFrame:
    return _events(documents, "documento_anexado", F.date_format("criado_em", "yyyy-MM-dd HH:mm:ss"), [F.col("arquivo_nome"), F.col("tamanho_bytes")],
                   envio_id=F.col("envio_id"), doc_id=F.col("doc_id"), inep=F.col("inep"))


def mark_events(accepted: DataFrame) -> DataFrame:
    """One event per accepted change of a mark, with the state it left behind. A pair's changes are made by hand, one after the
    other; they pass a task as a sorted stream."""
    until = W.partitionBy("run_id", "par_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    cleared = F.coalesce(~F.col("falso_positivo"), F.lit(False))

    def text_state(column: str) -> Column:
        """The last text written, where unmarking writes an empty one."""
        written = F.when(F.col(column).isNotNull() | cleared, F.coalesce(column, F.lit("")))
        return F.nullif(F.last(written, ignorenulls=True).over(until), F.lit(""))

    flag = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(until), F.lit(False)).alias(c)
    state = accepted.select("run_id", "par_id", "ts", flag("falso_positivo"), text_state("motivo_codigo").alias("motivo_codigo"),
                            text_state("motivo").alias("motivo"), flag("mae_filho"))
    detail = [F.col(c) for c in ("run_id", "falso_positivo", "motivo_codigo", "motivo", "mae_filho")]
    return _events(state, "marcacao_alterada", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), detail, par_id=F.col("par_id"))


def lot_schools(lines: DataFrame) -> DataFrame:
    return lines.select("envio_id", F.explode(F.array("inep_a", "inep_b")).alias("inep")).distinct()


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of stores in order of trust; a key comes whole from the first store that has it."""
    tagged = None
    for rank, df in enumerate(sources):
        part = df.withColumn("__rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in tagged.columns if c not in (*keys, "__rank")]
    best = tagged.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__rank").alias("__v"), F.min("__rank").alias("origem"))
    return best.select(*keys, "__v.*", "origem")


def lot_evidence(lots: DataFrame, snapshots: DataFrame, stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Cases of each lot: the database snapshot, else the stored copy, else today's cases. A lot never mixes sources."""
    def tagged(df: DataFrame, rank: int) -> DataFrame:
        return df.select("envio_id", "par_id", "snapshot", F.lit(rank).alias("__rank"))

    rows = tagged(snapshots, 0).unionByName(tagged(stored, 1)).unionByName(tagged(recomputed, 2))
    best = rows.groupBy("envio_id").agg(F.min("__rank").alias("__best"))
    return (
        rows.join(lots.select("envio_id"), "envio_id", "left_semi").join(best, "envio_id")
        .where("__rank = __best").select("envio_id", "par_id", "snapshot", F.col("__rank").alias("origem"))
    )


def admission(documents: DataFrame) -> DataFrame:
    """Adds ``motivo_recusa``: null when the document may be attached."""
    ext = text.file_extension("arquivo_nome")
    reason = (
        F.when(F.coalesce("tamanho_bytes", F.lit(0)) == 0, "vazio")
        .when(F.col("tamanho_bytes") > MAX_DOCUMENT_BYTES, "grande")
        .when(~ext.isin(*DOCUMENT_EXTENSIONS), "extensao")
    )
    return documents.withColumn("motivo_recusa", reason)


def document_rows(documents: DataFrame) -> DataFrame:
    """Ledger rows of the admitted documents."""
    stamp = F.date_format("criado_em", "yyyyMMdd_HHmmss")
    base = F.regexp_extract("arquivo_nome", r"([^/\\]*)$", 1)  # a path in the name is dropped
    safe = F.concat(stamp, F.lit("_"), text.safe_file_name(base))
    return admission(documents).where("motivo_recusa is null").select(
        text.document_id(F.col("envio_id"), F.col("inep"), F.col("criado_em")).alias("doc_id"), "envio_id", "inep",
        "arquivo_nome", F.concat_ws("/", "envio_id", F.col("inep").cast("string"), safe).alias("arquivo_path"),
        "sha256", "tamanho_bytes", text.mime_type("arquivo_nome").alias("tipo_mime"), "criado_em",
    )


def documents_by_school(documents: DataFrame) -> DataFrame:
    """Per lot and school: how many documents and their newest. The documents themselves stay rows, newest first."""
    return documents.groupBy("envio_id", "inep").agg(
        F.count(F.lit(1)).alias("documentos"), F.sum("tamanho_bytes").alias("bytes"),
        F.max_by("doc_id", F.struct("criado_em", "doc_id")).alias("mais_recente"))


def newest_first(rows: DataFrame, created: str, key: str, limit: int | None = None) -> DataFrame:
    """The whole list, or its first rows."""
    out = rows.orderBy(F.desc(created), F.desc(key))
    return out if limit is None else out.limit(limit)


def delete_lot(lots: DataFrame, lines: DataFrame, documents: DataFrame, trail: DataFrame, envio_id: str, when: Column):
    """(lots, lines, documents, trail) after removing a lot: children go with it, the trail gains an entry."""
    keep = F.col("envio_id") != envio_id
    entry = lots.where(~keep).select(
        *[(F.lit("envio_removido") if c == "tipo" else F.col("envio_id") if c == "envio_id" else when
           if c == "criado_em" else F.lit(None)).cast(trail.schema[c].dataType).alias(c) for c in trail.columns])
    return lots.where(keep), lines.where(keep), documents.where(keep), trail.unionByName(entry)


def run_status(runs: DataFrame, current_run: str = "") -> DataFrame:
    """A run still marked as processing that is not the current one was interrupted."""
    orphaned = (F.col("status") == "processando") & (F.col("run_id") != current_run)
    return runs.withColumn("status", F.when(orphaned, "interrompido").otherwise(F.col("status")))


def missing_runs(on_disk: DataFrame, stored: DataFrame) -> DataFrame:
    return on_disk.join(stored.select("run_id"), "run_id", "left_anti")


def completed(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'concluido'")
