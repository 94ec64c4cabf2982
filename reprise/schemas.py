"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "register": "escola_id_bubble string, inep bigint, uf string, fornecedor string, tipo_fornecedor string, "
    "status_geral string, fase string, books array<string>, atualizacao timestamp, ativacao_rede_externa timestamp, "
    "ativacao_rede_interna timestamp",
    "register_csv": "INEP string, UF string, fornecedor_ri string, fornecedor_re string, FASE string, "
    "`Status Geral` string, Books string, Atualizacao string, `Ativação Rede externa` string, "
    "`Ativação Rede interna` string",
    "occurrence": "inep bigint, uf string, fornecedor string, fase string, pdf_filename string, pdf_url string, "
    "pagina int, paginas array<int>, ocorrencias_no_pdf int, width int, height int, sha256 string, phash string, "
    "thumb_url string",
    "hash_memo": "s string, p string, w int, h int, t string",
    "coordinate": "s string, lat double, lon double",
    "pair": "grupo_id string, inep_a bigint, uf_a string, fornecedor_a string, pdf_filename_a string, pagina_a int, "
    "thumb_url_a string, inep_b bigint, uf_b string, fornecedor_b string, pdf_filename_b string, pagina_b int, "
    "thumb_url_b string, tipo_duplicata string, similaridade double, distancia_hamming int, sha256 string",
    "run": "run_id string, fase string, fornecedor string, status string, iniciado_em string, concluido_em string, "
    "metricas map<string,bigint>, meta string, classes map<string,string>",
    "run_group": "run_id string, grupo_id string, tipo string, fornecedor string, qtd_ineps bigint, "
    "qtd_ocorrencias bigint, qtd_shas bigint",
    "mark": "run_id string, par_id string, falso_positivo boolean, motivo_codigo string, motivo string, "
    "mae_filho boolean, inep_a bigint, inep_b bigint, atualizado_em timestamp, atualizado_por string",
    "mark_event": "run_id string, par_id string, ts timestamp, seq bigint, falso_positivo boolean, "
    "motivo_codigo string, motivo string, mae_filho boolean, inep_a bigint, inep_b bigint, autor string",
    "lot": "envio_id string, run_id string, fase string, criado_em timestamp, autor string, observacao string, "
    "status string, resumo string",
    "document": "doc_id string, envio_id string, inep bigint, par_id string, arquivo_nome string, arquivo_path string, "
    "bucket string, sha256 string, tamanho_bytes bigint, tipo_mime string, observacao string, enviado_por string, "
    "criado_em timestamp",
    "trail": "tipo string, envio_id string, par_id string, doc_id string, inep bigint, detalhe string, "
    "criado_em timestamp",
    "pending": "tipo string, carga string, criado_em double",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


# Marker fields that older and newer cache files mix in between occurrences.
PDF_MARKER, SCHOOL_MARKER = "_pdf_ok", "_escola_concluida"


def cache_line() -> StructType:
    """An occurrence line, a completion marker, or a line that could not be read."""
    return StructType(schema("occurrence").fields).add(PDF_MARKER, "string").add(SCHOOL_MARKER, "string").add(
        "_corrupt", "string")
