"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans are built from thousands of small expressions; recording the Python call site of each costs seconds.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # BLAS threads inside Arrow workers would fight the executor's own cores.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app_name: str = "reprise", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster such a folder would live on one machine and the
    loss of that machine would lose the data that replaced the lineage.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="reprise-checkpoint-")
    return _LOCAL_DIRS[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    Column pruning gives each branch its own plan, so Spark would otherwise scan and shuffle the source once per branch.
    The written table also cuts lineage, outlives lost executors and tells the planner its true size.
    """
    path = scratch_path(df.sparkSession, label)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path  # noqa: SLF001 - for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialise` returned. What is read later must not depend on them: it was written itself."""
    for table in tables:
        spark, path = table.sparkSession, table._written_at  # noqa: SLF001
        _delete(spark, path)
        _WRITTEN.get(spark.sparkContext.applicationId, []).remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - PySpark has no public file system
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001


_ONCE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The written table of that label and key, worked out by the first caller of this session.

    ``key`` must change with the inputs. :func:`forget` lets go of what a session wrote.
    """
    full = (spark.sparkContext.applicationId, label, *key)
    if full not in _ONCE:
        _ONCE[full] = materialise(build(), label)
    return _ONCE[full]


def forget(spark: SparkSession) -> None:
    """Deletes the tables that :func:`once` keeps for this session and every other one that :func:`materialise` wrote."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _ONCE if k[0] == app]:
        del _ONCE[key]
    for path in _WRITTEN.pop(app, []):
        _delete(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a written intermediate table or a stream checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
