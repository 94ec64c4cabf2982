"""Report tables and export projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions import text


def evidence_manifest(member_rows: DataFrame) -> DataFrame:
    """Source file and target path ``G/INEPx_UF_pN_name.jpg`` of every group member."""
    target = F.concat(
        F.col("grupo_id"), F.lit("/INEP"), F.coalesce(F.col("inep").cast("string"), F.lit("None")), F.lit("_"),
        F.coalesce("uf", F.lit("None")), F.lit("_p"), F.coalesce(F.col("pagina").cast("string"), F.lit("None")), F.lit("_"),
        text.safe_member_name("pdf_filename"), F.lit(".jpg"))
    return member_rows.select("grupo_id", "thumb_url", target.alias("destino"))


# Fixed values ---------------------------------------------------------------------------------------------------------
SUMMARY_LABELS = {
    "escolas": "Total de Escolas Analisadas", "imagens": "Total de Imagens Extraídas", "pares": "Pares de Duplicatas Encontrados",
    "exatos": "Duplicatas Exatas (100%)", "visuais": "Duplicatas Visuais (<100%)",
}
SIDE_LABELS = {"inep": "INEP", "uf": "UF", "fornecedor": "Fornecedor", "pdf_filename": "PDF", "pagina": "Página"}
# ----------------------------------------------------------------------------------------------------------------------


def summary_sheet(schools: DataFrame, occ: DataFrame, totals: DataFrame) -> DataFrame:
    """First sheet: one row for each count. ``totals`` has one row (exatos, visuais)."""
    n, row = F.count(F.lit(1)), F.lit(1).alias("__row")
    one = totals.select("exatos", "visuais", row).join(schools.agg(n.alias("escolas")).select("*", row), "__row").join(
        occ.agg(n.alias("imagens")).select("*", row), "__row").withColumn("pares", F.col("exatos") + F.col("visuais"))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("Métrica"), F.col(c).cast("bigint").alias("Valor")) for c, label in SUMMARY_LABELS.items()])))


def schools_sheet(sides: DataFrame) -> DataFrame:
    """Second sheet: affected schools, the most affected first."""
    return sides.select("inep", "uf", "fornecedor", "count").orderBy(F.desc("count"), "inep")


def pairs_sheet(pairs: DataFrame) -> DataFrame:
    """Third sheet: the pairs themselves."""
    return pairs.select(
        F.col("tipo_duplicata").alias("Tipo Duplicata"),
        F.concat(F.col("similaridade").cast("string"), F.lit("%")).alias("Similaridade (%)"),
        F.col("distancia_hamming").alias("Distância Hamming"),
        *[F.col(f"{c}_{s.lower()}").alias(f"{label} {s}") for s in "AB" for c, label in SIDE_LABELS.items()],
        F.col("sha256").alias("SHA256 Imagem"))
