"""From PDFs to image occurrences: pending work, filters and folding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions import hashing, images, text
from reprise.operators import skew

EXPLODED_SCHEMA = "pdf_url string, xref int, pagina int, width int, height int, uniforme boolean, conteudo binary"


def pending_pdfs(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return tasks.join(done.select("pdf_url"), "pdf_url", "left_anti")


def scope_counts(cached: DataFrame, tasks: DataFrame) -> DataFrame:
    """How many cached occurrences belong to the selected PDFs and how many lie outside."""
    wanted = tasks.select("pdf_url").distinct().withColumn("__in", F.lit(True))
    return cached.join(wanted, "pdf_url", "left").agg(
        F.count_if(F.col("__in").isNotNull()).alias("no_recorte"), F.count_if(F.col("__in").isNull()).alias("fora_do_recorte"))


def in_scope(cached: DataFrame, tasks: DataFrame) -> DataFrame:
    return cached.join(tasks.select("pdf_url"), "pdf_url", "left_semi")


def extract(pdfs: DataFrame, extractor: Callable[[str, bytes], list[dict]], errors: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """Run a per-file image extractor over ``binaryFile`` rows (path, content), one file at a time.

    Decoding is the plug-in's business; hashing, filtering and folding stay in the DataFrame. A file that raises one of the
    decoder's ``errors`` yields no rows and shows up in :func:`pdf_status`; any other exception is a fault and ends the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in EXPLODED_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = extractor(path, bytes(content))
                except errors:
                    found = []
                yield pd.DataFrame([{"pdf_url": path, **row} for row in found], columns=columns)

    return pdfs.select("path", "content").mapInPandas(run, EXPLODED_SCHEMA)


def pdf_status(pdfs: DataFrame, exploded: DataFrame) -> DataFrame:
    """Status row per PDF. A file without images is not marked done, so a failed one is tried again."""
    found = exploded.groupBy("pdf_url").agg(F.count(F.lit(1)).alias("imagens"))
    return pdfs.select(F.col("path").alias("pdf_url")).join(found, "pdf_url", "left").select(
        "pdf_url", F.coalesce("imagens", F.lit(0)).alias("imagens"),
        F.when(F.col("imagens").isNull(), "vazio_ou_falha").otherwise("ok").alias("status"))


def with_digest(exploded: DataFrame) -> DataFrame:
    return exploded.withColumn("sha256", hashing.sha256(F.col("conteudo"))).drop("conteudo")


def valid_images(
    rows: DataFrame, min_width: int = images.MIN_WIDTH, min_height: int = images.MIN_HEIGHT
) -> DataFrame:
    """Drop small images, the known logo and images of one colour (``uniforme`` of :func:`reprise.operators.rasters.with_measures`)."""
    return rows.where(
        (F.col("width") >= min_width) & (F.col("height") >= min_height) & (F.col("sha256") != images.DISCARDED_SHA)
        & ~F.coalesce(F.col("uniforme"), F.lit(False)))


def fold_pages(rows: DataFrame) -> DataFrame:
    """One row per (PDF, image object): first page, page list and number of appearances.

    The page list is bounded by the pages of one report.
    """
    return rows.groupBy("pdf_url", "xref", "sha256").agg(
        F.min("pagina").alias("pagina"), F.sort_array(F.collect_list("pagina")).alias("paginas"),
        F.count(F.lit(1)).alias("ocorrencias_no_pdf"))


def new_contents(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """Digests the memo does not know: only these pay for decoding and hashing. One row each."""
    first = rows.groupBy("sha256").agg(F.min(F.struct("pdf_url", "xref", "pagina")).alias("__first"))
    return skew.unmatched(first, memo, ["sha256"]).select("sha256", "__first.*")


def thumbnails(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Thumbnail of each digest: the first one made for it is reused. Only its name has the digest's first 16 characters.

    ``existing`` lists the files that are there (``name``): any of them with these characters is taken, the first by name, and
    ``nova`` tells which thumbnails are still to be drawn.
    """
    made = text.thumb_name(F.col("sha256"), F.col("pagina"), F.col("xref"))
    first = rows.groupBy("sha256").agg(F.min_by(made, F.struct("pdf_url", "pagina", "xref")).alias("thumb_url"))
    if existing is None:
        return first
    prefix = F.substring(F.element_at(F.split("name", "_"), 1), 1, 16)
    held = existing.where(F.lower("name").endswith(".jpg")).groupBy(prefix.alias("__prefix")).agg(F.min("name").alias("__name"))
    return first.withColumn("__prefix", F.substring("sha256", 1, 16)).join(held, "__prefix", "left").select(
        "sha256", F.coalesce("__name", "thumb_url").alias("thumb_url"), F.col("__name").isNull().alias("nova"))
