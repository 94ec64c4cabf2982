"""Rebuild a run from what was written downstream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions import hashing, text
from reprise.operators import groups, skew
from reprise.session import materialise


def day_of(rows: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of one day as a half-open range, which prunes partitions and row groups."""
    start = F.lit(day).cast("timestamp")
    return rows.where((F.col(column) >= start) & (F.col(column) < start + F.expr("interval 1 day")))


def pair_members(pairs: DataFrame) -> DataFrame:
    """Both sides of the pair rows as group members, one per (image, school, page); the last pair row wins."""
    fields = ("inep", "uf", "fornecedor", "pdf_filename", "pagina", "thumb_url")
    sides = pairs.select("sha256", "pair_seq", F.inline(F.array(*[
        F.struct(F.lit(i).alias("lado"), *[F.col(f"{c}_{s}").alias(c) for c in fields]) for i, s in enumerate("ab")])))
    return sides.where(groups.is_school()).groupBy("sha256", "inep", "pagina").agg(
        F.max_by(F.struct("uf", "fornecedor", "pdf_filename", "thumb_url"), F.struct("pair_seq", "lado")).alias("__m")
    ).select("sha256", "inep", "pagina", "__m.*")


def rebuild_groups(members: DataFrame) -> DataFrame:
    """Groups from pair members. Credit goes to the names all members share, else to the first supplier field."""
    size = members.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("qtd_ocorrencias"), F.min("inep").alias("lo"), F.max("inep").alias("hi"),
        F.min(F.nullif("fornecedor", F.lit(""))).alias("primeiro"),
        F.count_if(F.coalesce("fornecedor", F.lit("")) == "").alias("sem_fornecedor"),
    ).where("lo < hi").drop("lo", "hi")
    schools = members.select("sha256", "inep").distinct().groupBy("sha256").agg(F.count(F.lit(1)).alias("qtd_ineps"))
    names = (
        members.select("sha256", "inep", "pagina", F.explode(text.supplier_names("fornecedor")).alias("nome")).distinct()
        .groupBy("sha256", "nome").agg(F.count(F.lit(1)).alias("c"))
    )
    common = names.join(size.select("sha256", "qtd_ocorrencias", "sem_fornecedor"), "sha256").where(
        "c = qtd_ocorrencias and sem_fornecedor = 0").groupBy("sha256").agg(
        F.array_join(F.sort_array(F.collect_set("nome")), " / ").alias("comuns"))
    rebuilt = size.join(schools, "sha256").join(common, "sha256", "left").select(
        F.col("sha256").alias("cluster"), F.coalesce("comuns", "primeiro", F.lit("")).alias("fornecedor"), "qtd_ineps",
        "qtd_ocorrencias", F.lit(1).cast("bigint").alias("qtd_shas"), F.lit(hashing.EXACT_LABEL).alias("tipo"))
    return skew.ranked(rebuilt, ["qtd_ineps", "qtd_ocorrencias"], "cluster", "grupo_seq").withColumn(
        "grupo_id", groups.group_label(F.col("grupo_seq")))


def fill_urls(members: DataFrame, audited: DataFrame) -> DataFrame:
    """PDF address by (image, school, page), else by (image, school). Only audited rows of wanted images are aggregated."""
    def ends(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sha256", "inep", "pagina").agg(
            F.max_by("pdf_url", "occ_id").alias("__exact"), F.min_by("pdf_url", "occ_id").alias("__first"),
            F.min("occ_id").alias("__id"))

    found = materialise(skew.reduce_wanted(audited, members.select("sha256").distinct(), "sha256", ends), "found-urls")
    exact = found.select("sha256", "inep", "pagina", "__exact")
    loose = found.groupBy("sha256", "inep").agg(F.min_by("__first", "__id").alias("__loose"))
    return (
        members.join(exact, ["sha256", "inep", "pagina"], "left").join(loose, ["sha256", "inep"], "left")
        .withColumn("pdf_url", F.coalesce(F.nullif("__exact", F.lit("")), F.nullif("__loose", F.lit(""))))
        .drop("__exact", "__loose")
    )


def missing_evidence(member_rows: DataFrame, files: DataFrame) -> DataFrame:
    """PDFs to open again, with the number of evidence files to restore from each. ``files`` lists existing names."""
    needed = member_rows.where("thumb_url <> '' and pdf_url <> ''").groupBy("thumb_url").agg(
        F.max_by(F.struct("sha256", "pdf_url", "pagina"), F.struct("grupo_seq", "inep", "pdf_filename", "pagina", "occ_id"))
        .alias("__m"))
    absent = skew.unmatched(needed, files.select(F.col("name").alias("thumb_url")), ["thumb_url"])
    return absent.groupBy(F.col("__m.pdf_url").alias("pdf_url")).agg(F.count(F.lit(1)).alias("arquivos"))
