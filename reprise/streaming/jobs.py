"""Structured Streaming forms of the incremental paths. Each runs on what has arrived and stops (``availableNow``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.functions import text
from reprise.operators import marks, skew
from reprise.operators.groups import is_school
from reprise.session import materialise, scratch_path
from reprise.sources.keyed import KeyedTable
from reprise.sources.sinks import exists, write_upsert


def stream_table(spark: SparkSession, folder: str, glob: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append_stream(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Plain incremental append; restarts continue after the last committed batch."""
    drain(rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option(
        "path", target))


def first_seen(rows: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the delay. The watermark bounds the remembered keys."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


#: Buckets of a memo; a batch reads those that its keys fall into.
MEMO_BUCKETS = 32


def _memo_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def memo_rows(spark: SparkSession, target: str, fields: list[T.StructField], touched: list[int], batch_id: int) -> DataFrame:
    """Rows of the touched buckets that earlier batches wrote; the partition filter opens no other folder."""
    stored = T.StructType([*fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(stored).parquet(target).where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))


def append_unseen(rows: DataFrame, keys: list[str], target: str, checkpoint: str, *smallest: str, buckets: int = MEMO_BUCKETS) -> None:
    """Resumable memo: per batch, only keys the written table lacks are appended, with the smallest value of further columns.

    The table is the state, so it survives any restart and never has to fit in an executor. It lies in buckets by a hash
    of the key, of which a batch reads those that its own keys fall into.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.groupBy(*keys).agg(*[F.min(c).alias(c) for c in smallest]) if smallest else batch.select(*keys).distinct()
        spark = batch.sparkSession
        fields = once.schema.fields
        fresh = materialise(once.withColumn("bucket", _memo_bucket(keys, buckets)), "memo-batch")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        if exists(spark, target):
            # A replayed batch must not meet its own rows, or it would write none.
            fresh = skew.unmatched(fresh, memo_rows(spark, target, fields, touched, batch_id), [*keys, "bucket"])
        (
            fresh.withColumn("batch_id", F.lit(batch_id)).repartition("bucket").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(target)
        )

    drain(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def keep_smallest(rows: DataFrame, keys: list[str], columns: list[str], target: str, checkpoint: str) -> None:
    """Memo of the smallest values ever seen for each key, whatever the order of arrival; a batch merges into its own buckets."""

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns])

    def write(batch: DataFrame, batch_id: int) -> None:
        picked = batch.select(*keys, *columns)
        KeyedTable(batch.sparkSession, target, keys, picked.schema).merge(picked, columns, version=batch_id, combine=smallest)

    drain(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def mark_events_to_trail(events: DataFrame, trail: str, checkpoint: str) -> None:
    """Accepted events go to the append-only trail, from which :func:`marks.current_marks` folds the state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            marks.accepted(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(trail)
        )

    drain(events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def replay_queue(queue: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, newest: bool = False) -> None:
    """Rows of one kind: each batch is merged by natural key into its own version of the table, so a replay changes nothing.
    With ``newest`` a row that arrives late does not replace one that is later by ``order``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_upsert(batch, target, keys, [order], version=batch_id, newest=newest)

    drain(queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def known_images(known: DataFrame, label: str = "known-images", block: int = skew.PAIR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(history, crowded): the history as one row per (image, school), reduced and written once, and the slices of the few images
    that more than ``block`` schools hold. A slice holds about ``block`` schools of an image."""
    once = known.where(is_school()).groupBy("sha256", F.col("inep").alias("outro_inep")).agg(
        F.array_distinct(F.flatten(F.collect_set(text.supplier_names("fornecedor")))).alias("outros_nomes"))
    once = materialise(once, f"{label}-once")
    crowded = once.groupBy("sha256").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices")).where("slices > 1")
    crowded = materialise(crowded, f"{label}-crowded")
    sliced = once.join(crowded, "sha256", "left").withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64("outro_inep"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
    return materialise(sliced, label), crowded


def alerts(incoming: DataFrame, history: DataFrame, crowded: DataFrame) -> DataFrame:
    """Incoming occurrences whose image another school of the same supplier already holds, one row per such school. An
    occurrence of a crowded image goes to all its slices, any other to one."""
    asked = incoming.where(is_school()).join(crowded, "sha256", "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return (
        asked.join(history, ["sha256", "slice"])
        .where((F.col("inep") != F.col("outro_inep"))
               & F.arrays_overlap(text.supplier_names("fornecedor"), F.col("outros_nomes")))
        .drop("outros_nomes", "slice")
    )


def known_image_alerts(incoming: DataFrame, known: DataFrame, target: str, checkpoint: str, columns: list[str]) -> None:
    """Alerts of a stream against the history as it was when the stream started. The history is reduced once; each batch
    meets it as a plain join, whose crowded images are sliced, and writes its own partition of ``target``."""
    history, crowded = known_images(known)

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            alerts(batch, history, crowded).select(*columns).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)
        )

    drain(incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def run_to_table(rows: DataFrame, label: str) -> DataFrame:
    """Drain a stream into a fresh table of the shared folder and read it back."""
    spark = rows.sparkSession
    target = scratch_path(spark, label)
    append_stream(rows, target, scratch_path(spark, f"{label}-offsets"))
    return spark.read.schema(rows.schema).parquet(target)
