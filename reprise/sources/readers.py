"""Scans. Filters and column choice stay in the plan, so they reach the files or the JDBC source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions.hashing import hex_to_long
from reprise.schemas import PDF_MARKER, SCHOOL_MARKER, cache_line, schema
from reprise.sources import json_map


def read_table(spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema(name)) if name else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Range-partitioned database scan in place of numbered pages."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def read_register_csv(spark: SparkSession, path: str) -> DataFrame:
    """Register export with every field as text; the header decides the columns."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, finished PDFs) of a line-JSON cache; unreadable lines and school markers are left out."""
    lines = spark.read.schema(cache_line()).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = lines.where("_corrupt is null")
    rows = good.where(F.col(PDF_MARKER).isNull() & F.col(SCHOOL_MARKER).isNull()).drop(
        PDF_MARKER, SCHOOL_MARKER, "_corrupt")
    done = good.where(F.col(PDF_MARKER) != "").select(F.col(PDF_MARKER).alias("pdf_url")).distinct()
    return rows.withColumn("phash", hex_to_long(F.col("phash"))), done


def _last_line_wins(rows: DataFrame, key: str) -> DataFrame:
    """Later files and later lines win. Within one file the line order is the scan order."""
    placed = rows.select("*", F.struct(
        F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id()).alias("__at"))
    rest = [c for c in rows.columns if c != key]
    return placed.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*rest), "__at").alias("__v")).select(key, "__v.*")


def read_hash_memo(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema("hash_memo")).option("mode", "DROPMALFORMED").json(path)
    return _last_line_wins(rows, "s").select(
        F.col("s").alias("sha256"), hex_to_long(F.col("p")).alias("phash"), F.col("w").alias("width"),
        F.col("h").alias("height"), F.col("t").alias("thumb_url"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """A row without a coordinate means the image was read and nothing found; no row means it was not read."""
    rows = spark.read.schema(schema("coordinate")).option("mode", "DROPMALFORMED").json(path)
    return _last_line_wins(rows, "s").withColumnRenamed("s", "sha256")


def read_json_map(spark: SparkSession, path: str, value_type: str, key: str = "chave", value: str = "valor") -> DataFrame:
    """JSON object files (classes, marks) as key-value rows; a large object is read by many tasks."""
    return json_map.read_map(spark, path, value_type, key, value)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def read_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """PDF folder or upload area as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def list_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """Names of existing files; the content column is pruned, so nothing is opened."""
    return read_pdfs(spark, path, glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


#: Words of 64 bits of the filter that a digest list becomes, and places that a digest takes in it. 128 kB whatever the list's
#: length; up to some 100,000 digests it lets about one row in fifty through by mistake, and never drops one.
FILTER_WORDS, FILTER_PLACES = 1 << 14, 3


def _places(column: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(FILTER_WORDS * 64)) for i in range(FILTER_PLACES)]


def digest_filter(wanted: DataFrame, column: str = "sha256") -> DataFrame:
    """The list as one row: a Bloom filter, an array of ``FILTER_WORDS`` longs."""
    words = wanted.select(F.explode(F.array(*_places(column))).alias("place")).groupBy(
        F.floor(F.col("place") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits"))
    every = wanted.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda x: x["bits"]).alias("filter"))


def rows_with_digests(rows: DataFrame, wanted: DataFrame, column: str = "sha256") -> DataFrame:
    """Lookup by digest list. A Bloom filter of the list, read once as a scalar subquery, drops most rows where they are scanned;
    the exact join sees the others only, so a long table is not shuffled for a short list."""
    bits = digest_filter(wanted, column).scalar()
    test = F.lit(True)
    for place in _places(column):
        test = test & (F.getbit(F.get(bits, F.floor(place / 64).cast("int")), place % 64) == 1)
    return rows.where(test).join(wanted.select(column).distinct(), column, "left_semi")
