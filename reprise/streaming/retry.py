"""Retry queue of failed writes: items of several kinds go to their tables, failures stay queued with a reason.

An item is (item_id, tipo, carga, criado_em, tentativas); ``carga`` is JSON: an object, or a list of objects, of the kind's
row, and for ``envio_completo`` an object with ``cabecalho`` and ``linhas``. In one ``foreachBatch`` the items are taken
apart, checked and routed: kinds with a natural key are merged by it, newest item first, events are appended once. An item
is written whole or not at all: if one of its rows is refused, the item goes to the dead letters of its batch with its
attempts counted up. :func:`requeue` gives the dead letters back as the next queue.

Every write names its batch: keyed tables take the batch number as their version, events and dead letters replace the
partition of the batch. So a batch that ran half and is run again changes nothing twice. Batches of a later run go on counting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.session import materialise
from reprise.sources.keyed import KeyedTable
from reprise.sources.sinks import exists

# Fixed values ---------------------------------------------------------------------------------------------------------
#: Kinds with their natural keys; events have none and are only ever added.
KEYS = {"envio": ["envio_id"], "pares": ["envio_id", "par_id"], "documento": ["doc_id"]}
EVENT, WHOLE = "evento", "envio_completo"
# ----------------------------------------------------------------------------------------------------------------------

QUEUE = "item_id bigint, tipo string, carga string, criado_em double, tentativas int"
UNKNOWN, UNREADABLE, NO_KEY, REFUSED = "tipo desconhecido", "carga ilegível", "sem chave", "recusado"
_ORDER = ["fila_em", "fila_item"]


@dataclass(frozen=True)
class Route:
    """Where rows of a kind go: their schema, natural key (none: append only), and which rows the store refuses."""

    schema: T.StructType
    keys: tuple[str, ...] = ()
    refuses: Column | None = None


def routes(schemas: dict[str, T.StructType], refuses: dict[str, Column] | None = None) -> dict[str, Route]:
    return {kind: Route(s, tuple(KEYS.get(kind, ())), (refuses or {}).get(kind)) for kind, s in schemas.items()}


def _parts(items: DataFrame) -> DataFrame:
    """(item_id, criado_em, kind, row): the rows of every item as JSON; a whole lot is its header and its lines. Unreadable
    items have none."""
    as_list = lambda c: F.from_json(F.when(F.substring(F.ltrim(c), 1, 1) == "[", c).otherwise(F.concat(F.lit("["), c, F.lit("]"))), "array<string>")
    carga, whole = F.col("carga"), F.col("tipo") == WHOLE
    header = F.get_json_object(carga, "$.cabecalho")
    lines = F.get_json_object(carga, "$.linhas")
    tagged = lambda kind, c: F.transform(F.coalesce(as_list(c), F.array().cast("array<string>")), lambda x: F.struct(kind.alias("kind"), x.alias("row")))
    both = F.concat(tagged(F.lit("envio"), header), tagged(F.lit("pares"), lines))
    found = F.when(whole, both).otherwise(tagged(F.col("tipo"), carga))
    return items.select("item_id", "criado_em", F.explode(found).alias("part")).select("item_id", "criado_em", "part.kind", "part.row")


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column.cast("string")) == "", F.lit(True))


def replay_batch(items: DataFrame, table: dict[str, Route], root: str, batch: int) -> None:
    """Routes one batch of items. Tables lie under ``root`` by kind, dead letters under ``root/recusados``."""
    spark = items.sparkSession
    items = materialise(items.withColumn("legivel", F.coalesce(F.try_parse_json("carga").isNotNull(), F.lit(False))), "retry-items")
    known = F.col("tipo").isin(WHOLE, *table)
    parts = materialise(_parts(items.where(F.col("legivel") & known)), "retry-parts")
    refused = []
    for kind, route in table.items():
        rows = parts.where(F.col("kind") == kind).select("item_id", F.from_json("row", route.schema).alias("r")).select("item_id", "r.*")
        no_key = F.lit(False)
        for k in route.keys:
            no_key = no_key | _blank(F.col(k))
        reason = F.when(no_key, NO_KEY)
        if route.refuses is not None:
            reason = reason.when(F.coalesce(route.refuses, F.lit(False)), REFUSED)
        refused.append(rows.select("item_id", reason.alias("motivo")).where("motivo is not null"))
    bad = refused[0]
    for more in refused[1:]:
        bad = bad.unionByName(more)
    # A lot without a header, or an item without a row, has nothing to write.
    empty = items.where(F.col("legivel") & known).join(
        parts.groupBy("item_id").agg(F.count_if(F.col("kind") == "envio").alias("headers")), "item_id", "left").where(
        F.col("headers").isNull() | (F.col("tipo") == WHOLE) & (F.col("headers") == 0)).select("item_id", F.lit(NO_KEY).alias("motivo"))
    own = items.where(~(F.col("legivel") & known)).select("item_id", F.when(~known, UNKNOWN).otherwise(UNREADABLE).alias("motivo"))
    reasons = materialise(bad.unionByName(empty).unionByName(own).groupBy("item_id").agg(F.min("motivo").alias("motivo")), "retry-reasons")
    good = parts.join(reasons.select("item_id"), "item_id", "left_anti")
    for kind, route in table.items():
        extra = [F.col("criado_em").alias("fila_em"), F.col("item_id").alias("fila_item")]
        rows = good.where(F.col("kind") == kind).select(*extra, F.from_json("row", route.schema).alias("r")).select("r.*", *_ORDER)
        if route.keys:
            KeyedTable(spark, f"{root}/{kind}", list(route.keys), rows.schema).merge(rows, _ORDER, newest=True, version=batch)
        else:
            _replace(rows, f"{root}/{kind}", batch)
    dead = items.join(reasons, "item_id").withColumn("tentativas", F.coalesce("tentativas", F.lit(0)) + 1).drop("legivel")
    _replace(dead, f"{root}/recusados", batch)


def _replace(rows: DataFrame, path: str, batch: int) -> None:
    (
        rows.withColumn("batch_id", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def replay(queue: DataFrame, table: dict[str, Route], root: str, checkpoint: str, first_batch: int = 0) -> None:
    """Drains a stream of items. ``first_batch`` is the number of the first batch; a later run passes :func:`next_batch`."""

    def write(items: DataFrame, batch_id: int) -> None:
        replay_batch(items, table, root, first_batch + batch_id)

    queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def kept(spark: SparkSession, root: str, since: int = 0) -> DataFrame:
    """Items that stay queued after the run that began with batch ``since``: (item_id, tipo, carga, criado_em, tentativas, motivo)."""
    schema = T.StructType([*T.StructType.fromDDL(QUEUE).fields, T.StructField("motivo", T.StringType()), T.StructField("batch_id", T.LongType())])
    if not exists(spark, f"{root}/recusados"):
        return spark.createDataFrame([], schema).drop("batch_id")
    return spark.read.schema(schema).parquet(f"{root}/recusados").where(F.col("batch_id") >= since).drop("batch_id")


def next_batch(spark: SparkSession, root: str) -> int:
    """A number above those of all batches so far."""
    last = [-1]
    for kind in KEYS:
        last += KeyedTable(spark, f"{root}/{kind}").versions()
    return max(last) + 1


def requeue(spark: SparkSession, root: str, folder: str, since: int = 0, files: int | None = None) -> None:
    """Writes the kept items as files of a new queue, by default by as many tasks as read them."""
    items = kept(spark, root, since).drop("motivo")
    (items if files is None else items.repartition(files)).write.mode("append").parquet(folder)


def stored(spark: SparkSession, root: str, kind: str, route: Route) -> DataFrame:
    """The rows of a kind, without the columns that order them."""
    schema = T.StructType([*route.schema.fields, T.StructField("fila_em", T.DoubleType()), T.StructField("fila_item", T.LongType())])
    if route.keys:
        return KeyedTable(spark, f"{root}/{kind}", list(route.keys), schema).read().drop(*_ORDER)
    if not exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], route.schema)
    return spark.read.schema(schema).parquet(f"{root}/{kind}").drop(*_ORDER)
