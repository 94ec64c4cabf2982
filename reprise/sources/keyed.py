"""Tables merged by key: rows lie in buckets by a hash of their key, and a merge writes anew only the buckets it touches.

A version is a small manifest, ``root/v<n>``, that names for each bucket the merge that last wrote it; the rows are in
``root/data/v<n>/bucket=<b>``. Readers take the newest manifest that finished, so a failed or repeated job never hides the
state before it. The newest ``keep`` manifests stay, with the files they name; older files are deleted.

One writer at a time. A replayed merge passes its own ``version`` (a batch number), starts from the version before and
overwrites only that one. Rows whose key is null are one key, like any other value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.session import materialise
from reprise.sources.sinks import delete, exists, finished_versions, latest_per_key, list_names

BUCKETS = 64
KEEP = 3


@dataclass(frozen=True)
class Merge:
    """What a merge did: its version and the buckets it read and wrote."""

    version: int
    buckets: list[int] = field(default_factory=list)


class KeyedTable:
    """``schema`` may be left out to read what is there. The number of buckets is fixed when a table is first written; choose it so
    that a bucket of the grown table fits a task."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, schema: T.StructType | None = None,
                 buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.root, self.keys, self.schema, self.buckets, self.keep = spark, root.rstrip("/"), keys, schema, buckets, max(2, keep)

    # ---- reading

    def versions(self) -> list[int]:
        return finished_versions(self.spark, self.root)

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> the merge that wrote it; at most ``buckets`` rows."""
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/v{version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _rows(self, held: dict[int, int], schema: T.StructType | None) -> DataFrame | None:
        paths = [f"{self.root}/data/v{v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        known = self.versions()
        held = self.manifest(max(known) if version is None else version) if known else {}
        rows = self._rows(held, self.schema)
        if rows is None:
            if self.schema is None:
                raise FileNotFoundError(f"no finished version of {self.root} holds rows")
            rows = self.spark.createDataFrame([], self.schema)
        return rows

    # ---- writing

    def merge(self, changes: DataFrame, order: list[str], newest: bool = False, version: int | None = None,
              combine: Callable[[DataFrame], DataFrame] | None = None) -> Merge:
        """Merge by key. Of several changes with one key the last by ``order`` counts; it replaces the stored row or, with
        ``newest``, only one that is not later by ``order``. ``combine`` reduces the rows of each key by a rule of its own instead.
        """
        keys, schema = self.keys, self.schema or changes.schema
        known = [v for v in self.versions() if version is None or v < version]
        held = self.manifest(max(known)) if known else {}
        target = version if version is not None else max(known, default=-1) + 1
        once = combine(changes) if combine else latest_per_key(changes, keys, order)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        batch = materialise(once.select(*schema.names).withColumn("bucket", bucket), "keyed-changes")
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
        if touched:
            old = self._rows({b: held[b] for b in touched if b in held}, schema)
            rows = batch if old is None else self._merged(old.withColumn("bucket", bucket), batch, order, newest, combine)
            (
                rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket")
                .parquet(f"{self.root}/data/v{target}")
            )
        held |= dict.fromkeys(touched, target)
        self.spark.createDataFrame(sorted(held.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/v{target}")
        self._forget(target)
        return Merge(target, touched)

    def _merged(self, old: DataFrame, batch: DataFrame, order: list[str], newest: bool, combine) -> DataFrame:
        if combine:
            both = old.unionByName(batch).drop("bucket")
            return combine(both).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        both = old.withColumn("__turn", F.lit(0)).unionByName(batch.withColumn("__turn", F.lit(1)))
        by = F.struct(*order, "__turn") if newest else F.struct("__turn")
        rest = [c for c in old.columns if c not in (*self.keys, "bucket")]
        # Both sides have one row a key, and dealing out by bucket serves the grouping and the write.
        return (
            both.repartition("bucket").groupBy("bucket", *self.keys).agg(F.max_by(F.struct(F.lit(0).alias("__one"), *rest), by).alias("__v"))
            .select("bucket", *self.keys, *[F.col(f"__v.{c}").alias(c) for c in rest]).select(*old.columns)
        )

    def _forget(self, newest: int) -> None:
        """Deletes manifests older than the newest ``keep``, then the buckets that no manifest names."""
        known = [v for v in self.versions() if v <= newest]
        kept = known[-self.keep:]
        for v in known[:-self.keep]:
            delete(self.spark, f"{self.root}/v{v}")
        data = f"{self.root}/data"
        if len(known) <= self.keep or not exists(self.spark, data):
            return
        named = {(v, b) for k in kept for b, v in self.manifest(k).items()}
        for name in list_names(self.spark, data):
            v = int(name[1:]) if name[1:].isdigit() else None
            if v is None or v >= kept[0]:
                continue
            buckets = [n for n in list_names(self.spark, f"{data}/{name}") if n.startswith("bucket=")]
            gone = [n for n in buckets if (v, int(n.split("=")[1])) not in named]
            if len(gone) == len(buckets):
                delete(self.spark, f"{data}/{name}")
            else:
                for n in gone:
                    delete(self.spark, f"{data}/{name}/{n}")
