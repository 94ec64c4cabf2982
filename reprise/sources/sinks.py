"""Writers. Merges write the touched buckets of a table anew, run writes replace one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.sources import json_map

APPEND_BATCH = 500


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def append_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, batchsize=APPEND_BATCH, **options).save()


def latest_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of several changes with one key the last by ``order``."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(
        *keys, "__v.*").select(*changes.columns)


def write_upsert(changes: DataFrame, root: str, keys: list[str], order: list[str], version: int | None = None,
                 newest: bool = False, buckets: int = 64, keep: int = 3) -> list[int]:
    """Merge by key into a bucketed, versioned table (:mod:`reprise.sources.keyed`); returns the buckets written anew.

    Later changes by ``order`` win within a call; a stored row is always replaced, or with ``newest`` only by one that is not older.
    """
    from reprise.sources.keyed import KeyedTable  # that module is built on this one

    table = KeyedTable(changes.sparkSession, root, keys, changes.schema, buckets, keep)
    return table.merge(changes, order, newest, version).buckets


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - PySpark has no public file listing
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def finished_versions(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, root):
        return []
    names = list_names(spark, root)
    return sorted(int(n[1:]) for n in names if n[1:].isdigit() and exists(spark, f"{root}/{n}/_SUCCESS"))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hadoop)]


def modified(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, time of change, length) of what lies in a folder, sorted."""
    fs, hadoop = _file_system(spark, path)
    return sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(hadoop))


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    from reprise.sources.keyed import KeyedTable

    return KeyedTable(spark, root).read()


def write_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Meta, groups, members and audited rows of a run; only that run's partition is replaced."""
    for name, df in tables.items():
        (
            df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id").parquet(f"{root}/{name}")
        )


def delete_run(spark: SparkSession, root: str, run_id: str, tables: tuple[str, ...]) -> None:
    """Drop the run's partition of every table. The event trail lives elsewhere and stays."""
    for name in tables:
        delete(spark, f"{root}/{name}/run_id={run_id}")


def backup(df: DataFrame, path: str) -> None:
    """Snapshot before a write; refuses to replace an existing one."""
    df.write.mode("errorifexists").parquet(path)


def write_json_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """Key-value rows as JSON object files, one per task."""
    json_map.write_map(rows, key, value, path)


def write_case_csv(export: DataFrame, path: str) -> None:
    """Semicolon CSV with a byte-order mark in front of the header, as spreadsheets expect."""
    first = export.columns[0]
    marked = export.withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", "UTF-8").csv(path)


def write_report(sheets: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in sheets.items():
        plain = df.toDF(*[c.replace(" ", "_").replace("(%)", "pct") for c in df.columns]) if fmt == "parquet" else df
        plain.write.mode("overwrite").format(fmt).option("header", True).save(f"{root}/{name.replace(' ', '_').lower()}")
