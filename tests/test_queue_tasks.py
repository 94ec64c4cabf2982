"""A queue that grows is read by many tasks, in the first run and in the one of what it kept."""

from pyspark.sql import functions as F

from reprise.plans import stores
from reprise.plans.views import Views
from reprise.streaming import retry


def test_kept_items_are_requeued_by_as_many_tasks_as_read_them(spark, tmp_path):
    root, again = str(tmp_path / "root"), str(tmp_path / "again")
    items = spark.range(400_000).select(
        F.col("id").alias("item_id"), F.lit("laudo").alias("tipo"), F.sha2(F.col("id").cast("string"), 512).alias("carga"), F.lit(1.0).alias("criado_em"),
        F.lit(1).alias("tentativas"), F.lit("tipo desconhecido").alias("motivo"), F.lit(0).cast("long").alias("batch_id"))
    items.repartition(8).write.partitionBy("batch_id").parquet(f"{root}/recusados")
    retry.requeue(spark, root, again)
    written = spark.read.parquet(again)
    assert written.columns == ["item_id", "tipo", "carga", "criado_em", "tentativas"] and written.count() == 400_000
    assert written.select(F.input_file_name().alias("f")).distinct().count() > 1


def test_a_batch_has_a_file_for_each_core(spark, tmp_path):
    v = Views(spark, str(tmp_path))
    rows = spark.range(1000)
    cores = spark.sparkContext.defaultParallelism
    stream = stores._arriving(v, rows, "queue-tasks")
    folder = stream._jdf.queryExecution().analyzed().toString()
    assert "queue-tasks-arriving" in folder
    path = folder.split("FileSource[", 1)[1].split("]", 1)[0]
    kept = spark.read.parquet(path)
    assert kept.count() == 1000 and kept.select(F.input_file_name().alias("f")).distinct().count() >= cores * stores.BATCHES
