"""Were the photos of a PDF taken at one place?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions import geo, images
from reprise.operators import skew
from reprise.session import materialise

MICRO = 1000000


def eligible_photos(occ: DataFrame) -> DataFrame:
    """Camera photos filed under a school id."""
    return occ.where(images.geo_photo(F.col("width"), F.col("height"), F.col("pdf_filename")))


def unread_images(photos: DataFrame, readings: DataFrame) -> DataFrame:
    """Images that still need reading: one row per digest, those with a reading (even an empty one) left out."""
    images_ = photos.groupBy("sha256").agg(F.min("thumb_url").alias("thumb_url"))
    return skew.unmatched(images_, readings, ["sha256"])


def busiest_pdfs(photos: DataFrame, n: int) -> DataFrame:
    """Photos of the n PDFs with most photos (the demonstration sample)."""
    top = photos.groupBy("pdf_url").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "pdf_url").limit(n)
    return photos.join(top.select("pdf_url"), "pdf_url", "left_semi")


def _centre(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Median point per PDF. Medians run on whole micro-degrees, so each PDF is bounded by the size of the country box."""
    axes = points.select("pdf_url", F.inline(F.array(
        F.struct(F.lit("lat").alias("eixo"), F.round(F.col(lat) * MICRO).cast("bigint").alias("micro")),
        F.struct(F.lit("lon").alias("eixo"), F.round(F.col(lon) * MICRO).cast("bigint").alias("micro")))))
    medians = skew.exact_median(axes, ["pdf_url", "eixo"], "micro", "mediana")
    return medians.groupBy("pdf_url").agg(
        F.max(F.when(F.col("eixo") == "lat", F.col("mediana"))).alias("micro_lat"),
        F.max(F.when(F.col("eixo") == "lon", F.col("mediana"))).alias("micro_lon"),
    ).withColumns({"centro_lat": F.col("micro_lat") / MICRO, "centro_lon": F.col("micro_lon") / MICRO})


def photo_positions(photos: DataFrame, readings: DataFrame, radius_m: float = geo.RADIUS_M) -> DataFrame:
    """Every read photo with its repaired coordinate, distance to the PDF's median point and situation.

    The median resists a wrong reading; a provisional one guides the digit repair, a second one uses the repaired values.
    """
    read = materialise(
        photos.select("pdf_url", "occ_id", "sha256", "pagina").join(
            readings.where("lat is not null and lon is not null"), "sha256"), "read-photos")
    fixed = materialise(read.join(_centre(read, "lat", "lon"), "pdf_url").withColumn(
        "__r", geo.repair_digit(F.col("lat"), F.col("lon"), F.col("centro_lat"), F.col("centro_lon"))
    ).select(
        "pdf_url", "occ_id", "sha256", "pagina", F.bround("__r.lat", 6).alias("lat"),
        F.bround("__r.lon", 6).alias("lon"), "__r.reparado"), "fixed-photos")
    distance = geo.haversine_m(F.col("centro_lat"), F.col("centro_lon"), F.col("lat"), F.col("lon"))
    return (
        fixed.join(_centre(fixed, "lat", "lon"), "pdf_url").withColumn("__d", distance)
        .withColumn("situacao", geo.situation(F.col("__d"), radius_m))
        .withColumn("distancia_m", F.bround("__d", 1)).drop("__d")
    )


def pdf_geography(photos: DataFrame, readings: DataFrame, radius_m: float = geo.RADIUS_M) -> DataFrame:
    """One row per PDF with at least one read photo."""
    # Written first: behind the join on the PDF an aggregate would reuse its partitioning, a hot PDF uncombined in one task.
    positions = materialise(photo_positions(photos, readings, radius_m), "located-photos")
    totals = photos.groupBy("pdf_url").agg(F.count(F.lit(1)).alias("total"))
    front = F.min_by(F.struct("pagina", "distancia_m"), F.struct(F.coalesce("pagina", F.lit(0)), "occ_id"))
    summary = positions.groupBy("pdf_url").agg(
        F.first("micro_lat").alias("micro_lat"), F.first("micro_lon").alias("micro_lon"),
        F.count(F.lit(1)).alias("com_coordenada"), F.count_if(F.col("situacao") == geo.OUTSIDE).alias("fora_do_raio"),
        F.count_if(F.col("situacao") == geo.SUSPECT).alias("suspeitas"), F.count_if("reparado").alias("reparadas"),
        F.coalesce(F.max(F.when(F.col("situacao") != geo.SUSPECT, F.col("distancia_m"))), F.lit(0.0))
        .alias("distancia_max_m"), front.alias("__fachada"),
    )
    return summary.join(totals, "pdf_url").select(
        "pdf_url", (F.bround("micro_lat", 0) / MICRO).alias("centro_lat"),
        (F.bround("micro_lon", 0) / MICRO).alias("centro_lon"),
        F.lit(float(radius_m)).alias("raio_m"), "total", "com_coordenada",
        (F.col("total") - F.col("com_coordenada")).alias("sem_coordenada"), "fora_do_raio", "suspeitas", "reparadas",
        "distancia_max_m", F.col("__fachada.pagina").alias("fachada_pagina"),
        F.col("__fachada.distancia_m").alias("fachada_distancia_m"),
    )


def run_geography(summary: DataFrame) -> DataFrame:
    """Totals of a run."""
    return summary.agg(
        F.count(F.lit(1)).alias("pdfs_com_coordenada"), F.count_if(F.col("fora_do_raio") > 0).alias("pdfs_com_foto_fora"),
        F.coalesce(F.max(F.when(F.col("fora_do_raio") > 0, F.col("distancia_max_m"))), F.lit(0.0)).alias("distancia_max_m"),
    )


def largest_distances(summary: DataFrame, n: int = 8) -> DataFrame:
    return summary.where("fora_do_raio > 0").orderBy(F.desc("distancia_max_m"), "pdf_url").limit(n)
